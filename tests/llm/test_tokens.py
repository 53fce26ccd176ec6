"""Token files, alignment of tokenizers and conversation repair against the libraries and brute force."""

import array
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenweave.llm import align, segments, simple8b, tokenfiles, turns

SF = "/root/testdata/sf0.001"
JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    (1, None), (2, ""), (3, " "), (4, "  "), (5, "a"), (6, " a  b \n c\n"), (7, "x▁y"), (8, "日本語のテキスト " * 300), (9, "<s> </s><|endoftext|> <0x41> \t tab"), (None, "null id"), (None, "null id"),
    (10, "a  b　 c  d \u0085 e"), (11, "zero\x00byte \x1c x"), (12, "a" * 4000 + " b"), (13, "end "), (14, "🙂 🙂🙂 é é"), (15, "code;\r\n\r\n  if (x) {\r\n\t\treturn;}\n"), (16, "\n lead"),
    (17, "   many   spaces   "), (18, "don't I'LL we've 'tis 12 345,678 l'été! «x» “y”. d’un\nBar\n\nBaz\n qux.\nQ"), (18, "again"), (19, "word\n<|endoftext|>next"), (20, "x'll.y're,z's"), (21, "ǅ ʰa, ªb. ²c"),
    (22, "a\n'b\n,c \n"), (23, "wörd " * 40000),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(d, t, "other", 1) for d, t in ODD], "doc_id long, text string, ids string, start int").repartition(3)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.mark.parametrize("values", [[], [0] * 1000, list(range(50257)), [2**32 - 1, 0, 15, 14, 2**30 - 1, 2**30, 2**20], [0] * 255 + [9] * 3 + [0] * 300, [7, 70000] * 400])
def test_simple8b(values):
    words, escapes, first_word, first_escape = simple8b.pack(np.array(values, np.int64))
    assert simple8b.unpack(words, escapes, first_word, len(values)).tolist() == values
    assert len(first_word) == len(first_escape) == -(-len(values) // simple8b.BLOCK)
    with pytest.raises(ValueError):
        simple8b.pack(np.array([-1]))


def test_simple8b_escapes_are_cheaper():
    """One large value among small ones costs an escape, not a wide word for its neighbours."""
    rng = np.random.default_rng(5)
    v = rng.integers(0, 200, 4096)
    v[::64] = 1 << 31
    words, escapes, *_ = simple8b.pack(v)
    assert len(escapes) == 64 and 8 * len(words) + 4 * len(escapes) < 4096 * 1.5


def test_segment_reads_parts():
    rng = np.random.default_rng(1)
    sizes, ids = rng.integers(1, 900, 20), None
    ids = rng.integers(0, 50257, sizes.sum())
    s = tokenfiles.Segment(memoryview(tokenfiles.pack_segment([None, *range(19)], sizes, ids)))
    assert s.doc_ids[:3] == [None, 0, 1] and s.sizes.tolist() == sizes.tolist()
    for a, b in ((0, None), (0, 0), (255, 257), (256, 512), (1000, 1001), (int(sizes.sum()) - 1, None), (5, 10**9)):
        assert s.ids(a, b).tolist() == ids[a:b].tolist()


def test_op12(spark, library):
    rows = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id)
    got, start = {r.doc_id: r for r in tokenfiles.op12_token_files(spark, SF).collect()}, 0
    assert len(got) == len(rows)
    for r in rows:
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(array.array("I", ids).tobytes()))
        start += len(ids)


def test_op12_odd(spark, odd, library, tmp_path, monkeypatch):
    tokenfiles.write_ids(odd, f"{tmp_path}/a", JSON, end=7)
    rows = sorted(tokenfiles.read_ids(spark, f"{tmp_path}/a").collect(), key=lambda r: r.start)
    assert np.array_equal([r.start for r in rows], np.cumsum([0] + [len(r.ids) for r in rows])[:-1])
    assert [r.doc_id for r in rows] == [None, None, *sorted(d for d, _ in ODD if d is not None)]
    want = sorted((d is not None, d or 0, [*library.encode(t or "", add_special_tokens=False).ids, 7]) for d, t in ODD)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids) for r in rows) == want
    tokenfiles.write_ids(odd.limit(0), f"{tmp_path}/none", JSON)
    assert tokenfiles.read_ids(spark, f"{tmp_path}/none").count() == 0


def test_files_of_many_segments(spark, tmp_path, monkeypatch):
    """Records as the writer makes them with small segments, without Spark."""
    import types

    import pyarrow as pa

    monkeypatch.setattr(tokenfiles, "SEGMENT_IDS", 40)
    monkeypatch.setattr(tokenfiles, "FILE_SEGMENTS", 3)
    monkeypatch.setattr(tokenfiles, "SLICE_BYTES", 300)
    monkeypatch.setattr(tokenfiles, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 4)))
    texts = [t for _, t in ODD if t is None or len(t) < 3000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    records = [b.column(0)[0].as_py() for b in tokenfiles._writer(types.SimpleNamespace(value=tokenfiles.vocabulary(JSON)), 0)(iter([batch]))]
    files, body = [], b""
    for r in records:
        body += r + tokenfiles.MARK.encode()
        if r.startswith(tokenfiles.DIRECTORY):
            files.append(body)
            body = b""
    assert not body and len(files) > 1
    ids, docs = [], []
    for k, f in enumerate(files):
        part, number, found = tokenfiles.open_file(f)
        found = list(found)
        assert (part, number) == (4, k) and len(found) <= 3
        ids += [x for s in found for x in s.ids().tolist()]
        docs += [d for s in found for d in s.doc_ids]
    library = Tokenizer.from_file(JSON)
    assert docs == list(range(len(texts))) and ids == [x for t in texts for x in [*library.encode(t or "", add_special_tokens=False).ids, 0]]


def brute_alignment(rows):
    a = Tokenizer.from_file(JSON)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    table = segments.byte_level()
    a_bytes = {i: bytes(table[c] for c in s) for s, i in a.get_vocab(with_added_tokens=False).items()}

    def b_bytes(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    docs, holders, best = [], collections.Counter(), collections.defaultdict(int)
    for d, t in rows:
        links, groups = collections.Counter(), []
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        if x and b"".join(a_bytes[i] for i in x) == b"".join(b_bytes(i) for i in y) == (" " + t).encode():
            ex, ey = np.cumsum([len(a_bytes[i]) for i in x]).tolist(), np.cumsum([len(b_bytes(i)) for i in y]).tolist()
            p = q = 0
            for e in sorted(set(ex) & set(ey)):
                r, s = ex.index(e) + 1, ey.index(e) + 1
                groups.append((x[p:r], y[q:s]))
                links.update((m, n) for m in x[p:r] for n in y[q:s])
                p, q = r, s
        docs.append((d, groups, links))
        holders.update(links.keys())
    for (m, _), n in holders.items():
        best[m] = max(best[m], n)
    for d, g, links in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        yield (
            d, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(links.values()), sum(n for p, n in links.items() if holders[p] == best[p[0]]), sum(n * holders[p] for p, n in links.items()),
            hashlib.sha256(text.encode()).hexdigest() if g else "",
        )


def by_id(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


def test_op11(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r.text or "") < 20000]
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter(F.coalesce(F.length("text"), F.lit(0)) < 20000)
    assert by_id(align.align(docs, JSON, MODEL).collect()) == by_id(brute_alignment(rows))


def test_op11_odd(spark, odd, monkeypatch):
    short = odd.filter("doc_id IS NULL OR doc_id <> 23")
    want = by_id(brute_alignment([x for x in ODD if x[0] != 23]))
    assert by_id(align.align(short, JSON, MODEL).collect()) == want
    # pair counts joined instead of broadcast, several salts, small buckets
    for name, value in (("PAIRS", 0), ("SALT_BLOCKS", 1), ("BUCKET", 8)):
        monkeypatch.setattr(align, name, value)
    assert by_id(align.align(short, JSON, MODEL).collect()) == want
    assert align.align(odd.limit(0), JSON, MODEL).count() == 0
    (long,) = align.align(odd.filter("doc_id = 23"), JSON, MODEL).collect()
    assert long.n_a >= 40000 and long.n_best == long.n_links == long.count_sum


def test_segments_and_whole_texts_agree(odd):
    """Where the vocabularies are not found to split, one segment a text gives the same groups."""
    pair = align.Pair(tokenfiles.vocabulary(JSON), align.model_bytes(MODEL))
    assert pair.splits
    for _, t in ODD[:-1]:
        if t:
            import pyarrow as pa

            column = segments.as_bytes(pa.array([t]), " ")
            (whole,) = pair.align(segments.split(column, whole=True)[2])
            index, _, distinct = segments.split(column)
            parts = pair.align(distinct)
            assert (None in parts) == (whole is None)
            if whole:
                texts = align.Aligned(parts).texts()
                assert ";".join(texts[i] for i in index) == align.Aligned([whole]).texts()[0]


def test_links_in_small_steps_and_wide_numbers(monkeypatch):
    pair = align.Pair(tokenfiles.vocabulary(JSON), align.model_bytes(MODEL))
    some = [s.encode() for s in (" 日本語のテキスト", " the", " " + "ab" * 300, " déjà", " 日本")]
    want = [x.tolist() for x in align.Aligned(pair.align(some)).links()]
    monkeypatch.setattr(align, "SOME_LINKS", 3)
    assert [x.tolist() for x in align.Aligned(pair.align(some)).links()] == want
    monkeypatch.setattr(align, "WIDE", 1000)
    wide = pair.align(some)
    assert any(r[:2] == b"\xff\xff" for r in wide) and [x.tolist() for x in align.Aligned(wide).links()] == want


SPACE = " \t\n\x0b\f\r"


def brute_repair(rows):
    """{conv_id: (counts, cost, audit, hash)} of rows (conv_id, turn, role, text), by plain recursion on edits."""
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, " " if r is None else r, " " if x is None else x))
    out = {}
    for c, rs in by.items():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        known = {r[0] for r in rs if r[0] is not None}
        seen, fault = set(), []
        for _, r, x in rs:
            y = x.rstrip(SPACE)
            fault.append("b" if not y else "d" if (r, x) in seen else "t" if y[-1] not in ".!?" else "")
            seen.add((r, x))
        first = [r[1][:1] for r in rs]
        to, best = {"": "u", "s": "u", "u": "a", "a": "u"}, {}
        for t in range(len(rs), -1, -1):
            for depth in (0, 1, 2):
                for s in ("", "s", "u", "a"):
                    ways = [(0, "", ())] if t == len(rs) and s in ("", "a") else []

                    def add(cost, edit, line, t2, s2, d2, ways=ways):
                        if k := best.get((t2, s2, d2)):
                            ways.append((cost + k[0], edit + k[1], ((line,) if line is not None else ()) + k[2]))

                    if t < len(rs):
                        extra = 3 * (fault[t] == "t")
                        add(4, "D", None, t + 1, s, 2)
                        if fault[t] not in ("b", "d"):
                            if (s == "" and first[t] == "s") or first[t] == to[s]:
                                add(extra, "K", f"{rs[t][1]}:{rs[t][2]}", t + 1, first[t], 2)
                            add(3 + extra, "R", ("user:" if to[s] == "u" else "assistant:") + rs[t][2], t + 1, to[s], 2)
                    if depth:
                        add(3, "I", "user:" if to[s] == "u" else "assistant:", t, to[s], depth - 1)
                    if ways:
                        best[t, s, depth] = min(ways, key=lambda w: w[:2])
        cost, audit, lines = best[0, "", 2]
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
        out[c] = (gaps, fault.count("b"), fault.count("d"), fault.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def by_conv(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_op13(spark):
    rows, kept = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()], []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        kept += [(c, t, "user" if kind == 4 else r, x)] * {0: 0, 3: 2}.get(kind, 1)
    want = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in rows} | brute_repair(kept)
    assert by_conv(turns.op13_conversation_repair(spark, SF)) == want


@pytest.fixture(scope="module")
def talks(spark):
    rng, rows = random.Random(3), []
    for c in [None, *range(40)]:
        for _ in range(rng.choice([1, 2, 5, 9, 40])):
            rows.append((c, rng.choice([None, *range(12)]), rng.choice([None, "", "system", "user", "assistant", "tool", "user"]), rng.choice([None, "", " \n", "Hi.", "hello", "Yes! ", "a?", "b b", *[f"x{k}." for k in range(5)]])))
    rows += [(99, 1, "user", "long " * 50000 + "."), (99, 2, "assistant", "ok.")]
    return rows, spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, alive_since string")


@pytest.mark.parametrize("how", [{}, {"long": 4, "chunk": 3}, {"long": 0, "chunk": 1}])
def test_op13_odd(talks, how):
    """Conversations in one piece, and in chunks of a few rows."""
    rows, df = talks
    assert by_conv(turns.repair(df, **how)) == brute_repair(rows)


@pytest.mark.parametrize("how", [{}, {"long": 4, "chunk": 5}])
def test_repaired_turns(talks, how):
    rows, df = talks
    lines = collections.defaultdict(list)
    for r in sorted(turns.repaired_turns(df, **how).collect(), key=lambda r: r.place):
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(lines[c]).encode()).hexdigest() for c in {r[0] for r in rows}} == {c: v[-1] for c, v in brute_repair(rows).items()}


def test_op13_empty(talks):
    _, df = talks
    for f in (turns.repair, turns.repaired_turns):
        assert f(df.limit(0)).count() == 0
