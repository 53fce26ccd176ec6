"""Operator 3 (native): secret scan with a random forest for false-positive removal.

``candidates`` finds all runs of 16 or more key characters that hold a digit, wherever it is,
and all values of 6 or more characters assigned to a key word, in every whole text, with the
text around each and the document's path. ``with_features`` turns a
candidate into numbers by SQL expressions: length, transitions between character classes,
class shares, distinct characters, coverage by a dictionary, path and neighbouring words.
``fit`` trains a random forest on labelled findings; ``labelled_findings`` makes a bounded,
deterministic set of them from public key shapes and from look-alikes (digests, UUIDs,
card numbers, identifiers, versions), for use where no reviewed findings are at hand.
All of it runs in the JVM.

Cases: null and empty texts have no candidates; a null path is an empty one; repeated rows
repeat their findings; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.llm.common import cut, read

#: A candidate is such a run with a digit in it.
CANDIDATE = r"[A-Za-z0-9+/=_-]{16,}"
#: Words whose letters explain a candidate away.
DICTIONARY = "version|example|sample|image|static|content|index|page|file|data|user|name|test|file|info|order|number|report|group|value|type|list|item|table|column|row|model|class|public|private|service|client|server|request|response|config|default|system|build|release|update|module|package|format|color|width|height|title|article|section"
KEY_WORDS = r"token|secret|passw|pwd|api[_-]?key|apikey|auth|bearer|credential|private[_-]?key|access[_-]?key"
OTHER_WORDS = r"commit|sha-?[0-9]*|md5|checksum|digest|hash|uuid|guid|revision|etag|card|phone|account|isbn|order|invoice|build|version"
#: What a key word is assigned, whatever its length and characters: within a word, or at the start of the next.
_VALUE = r"[^\s\"'`,;&<>(){}\[\]]{6,}"
_KEY = "(?i)(?:" + KEY_WORDS.replace("auth|", "auth(?!or)|") + r")[A-Za-z0-9_-]{0,20}[\"']{0,2}"
ASSIGNED = _KEY + r"[=:]{1,2}[\"']{0,2}(" + _VALUE + ")"
ASSIGNING = _KEY + r"\s?[=:]{1,2}[\"']?$"
STARTING = r"^[\"']?(" + _VALUE + ")"
#: The name and sign in front of a value, inside a run.
NAMED = r"^([A-Za-z][A-Za-z0-9_-]*=+)[A-Za-z0-9+/_-]{6,}=*$"
#: All up to the last run with a digit.
OTHER_CANDIDATE = r"^.*(?=[A-Za-z0-9+/=_-]*[0-9])" + CANDIDATE
PLAIN_PATH = r"test|example|sample|mock|fixture|docs?/|changelog|lock"
FEATURES = ["f_len", "f_transitions", "f_digits", "f_upper", "f_hex", "f_distinct", "f_dictionary", "f_path", "f_key_word", "f_other_word", "f_assigned"]
LABELLED_ROWS = 6000
THRESHOLD = 0.5


def candidates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """One row per candidate: id, pos (index of its white-space separated word), at (index in the word), candidate, before, left, right, after, path.

    ``left`` and ``right`` are the parts of the word around a candidate; where a word holds
    several, they end at separators, and words around it belong to the outer ones.
    """
    hit = docs.filter(F.col(text).rlike(CANDIDATE) | F.col(text).rlike(_KEY)).select(F.col(id_col).alias("id"), F.coalesce(F.col(path), F.lit("")).alias("path"), F.split(text, r"\s+").alias("w"))
    near = lambda i, a, n: F.array_join(F.slice("w", F.greatest(i + a, F.lit(1)), n), " ")
    # cheap conditions that the expensive ones imply come first
    assigned = lambda i: F.get("w", i - 1).rlike("[=:][\"']?$") & near(i, -1, F.least(i, F.lit(2))).rlike(ASSIGNING) & F.get("w", i).rlike(STARTING)
    run_in = lambda c: (F.length(c) >= 16) & c.rlike("[0-9]") & c.rlike(CANDIDATE)
    at = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: run_in(F.get("w", i)) | (F.get("w", i).rlike("[=:]") & F.get("w", i).rlike(ASSIGNED)) | assigned(i))
    rows = hit.select(
        "id",
        "path",
        F.explode(
            F.transform(
                at, lambda i: F.struct(i.alias("pos"), near(i, -2, F.least(i, F.lit(3))).alias("before"), F.get("w", i).alias("own"), near(i, 2, F.lit(2)).alias("after"), F.coalesce(assigned(i), F.lit(False)).alias("assigned"))
            )
        ).alias("c"),
    ).select("id", "path", "c.*")
    rows = rows.withColumn("runs", F.regexp_extract_all("own", F.lit(CANDIDATE), 0)).withColumn("gaps", F.split("own", CANDIDATE, -1))
    first = F.when(F.col("assigned"), F.array(F.regexp_extract("own", STARTING, 1))).otherwise(F.array().cast("array<string>"))
    values = F.array_distinct(F.concat(first, F.regexp_extract_all("own", F.lit(ASSIGNED), 1)))
    digit = lambda r: r.rlike("[0-9]")
    values = F.filter(values, lambda x: ~F.exists(F.regexp_extract_all(x, F.lit(CANDIDATE), 0), digit) & ~F.exists("runs", lambda r: digit(r) & r.contains(x)))

    def run(x: Column, j: Column) -> Column:
        last, gap, rest = F.size("runs") - 1, F.get("gaps", j), F.get("gaps", j + 1)
        left = F.when(j == 0, gap).otherwise(F.regexp_extract(gap, "[^,;&|{}]*$", 0))
        right = F.when(j == last, rest).otherwise(F.regexp_extract(rest, "^[^,;&|{}]*", 0))
        before = F.when((j > 0) & left.rlike("[A-Za-z]"), "").otherwise(F.col("before"))
        name = F.regexp_extract(x, NAMED, 1)  # token=abc..: the name is context, the value the candidate
        own, left = F.substring(x, F.length(name) + 1, F.length(x)), F.concat(left, name)
        return F.struct(j.cast("int").alias("at"), own.alias("candidate"), before.alias("before"), left.alias("left"), right.alias("right"), F.when(j == last, F.col("after")).otherwise("").alias("after"))

    def value(x: Column, j: Column) -> Column:
        start = F.position(x, F.col("own"))
        left = F.substring(F.col("own"), F.greatest(start - 48, F.lit(1)), F.least(start - 1, F.lit(48)))
        return F.struct((F.size("runs") + j).cast("int").alias("at"), x.alias("candidate"), F.col("before").alias("before"), left.alias("left"), F.lit("").alias("right"), F.col("after").alias("after"))

    with_digit = F.filter(F.transform("runs", run), lambda f: digit(F.get("runs", f["at"])))
    found = F.explode(F.concat(with_digit, F.transform(values, value))).alias("f")
    return rows.select("id", F.col("pos").cast("long").alias("pos"), "path", found).select("id", "pos", "f.*", "path")


def _share(c: str, kept: str) -> Column:
    return F.length(F.regexp_replace(c, kept, "")) / F.length(c)


def with_features(found: DataFrame) -> DataFrame:
    c = "candidate"
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]", "9"), "[a-z]", "a"), "[A-Z]", "A")
    runs = F.regexp_replace(F.regexp_replace(classes, "[^9aA]", "-"), r"(.)\1*", "$1")
    # words up to another candidate in front belong to that one: token = "<key>" 4111..
    before = F.regexp_replace("before", OTHER_CANDIDATE, "")
    around = F.lower(F.concat_ws(" ", before, "left", "right", "after"))
    flag = lambda cond: cond.cast("double")
    return found.withColumns(
        {
            "f_len": F.length(c).cast("double"),
            "f_transitions": (F.length(runs) - 1) / F.length(c),
            "f_digits": _share(c, "[^0-9]"),
            "f_upper": _share(c, "[^A-Z]"),
            "f_hex": flag(F.col(c).rlike("^[0-9a-fA-F]+$")),
            "f_distinct": F.size(F.array_distinct(F.split(c, ""))) / F.length(c),
            "f_dictionary": 1 - F.length(F.regexp_replace(F.lower(c), DICTIONARY, "")) / F.length(c),
            "f_path": flag(F.lower("path").rlike(PLAIN_PATH)),
            "f_key_word": flag(around.rlike(KEY_WORDS)),
            "f_other_word": flag(around.rlike(OTHER_WORDS)),
            "f_assigned": flag(F.concat_ws(" ", before, "left").rlike("[=:][\\s\"']*$") | F.col(c).rlike("^=")),
        }
    )


def labelled_findings(spark: SparkSession, rows: int = LABELLED_ROWS, seed: int = 1) -> DataFrame:
    """(id, text, path, label, family): texts with one candidate each. 1: secret, 0: look-alike; family: the shape's number."""
    # each part is a column of its own behind an exchange, so that no expression is copied into all shapes
    base = spark.range(rows).select("id", F.sha2(F.concat_ws(":", F.lit(seed), "id").cast("string"), 512).alias("h")).repartition(2)
    h = F.col("h")
    pick = lambda names, at: F.element_at(F.split(F.lit(names), ","), (F.conv(F.substring(h, at, 3), 16, 10).cast("int") % len(names.split(","))) + 1)
    parts = {
        "b64": F.regexp_replace(F.base64(F.unhex(F.substring(h, 1, 96))), "=", ""),
        "digits": F.translate(F.substring(h, 1, 60), "abcdef", "123456"),
        "key": pick("token,secret,password,api_key,auth_token,access_key,client_secret,private_key,credential,bearer", 100),
        "word": pick("the,and,of,item,in,with,is,on,for,by", 104),
        "other": pick("commit,sha256,md5,checksum,digest,etag,revision,build", 108),
        "name": F.concat(pick("user,report,image,service,order,module,page,config", 112), pick("Table,Index,Version,Item,Group,Client,Page,Value", 116)),
        "sign": pick(" = \x22, : \x22,=,: ", 120),
        "plain": pick("example,default,user-name,file-name,public-value,sample-page", 122),
        "path": pick("src/app.py,src/main.go,test/data.json,docs/readme.md,settings.env,deploy.yaml,example/run.sh,web/page.html", 124),
    }
    base = base.select("id", "h", *[v.alias(k) for k, v in parts.items()]).repartition(2)
    b64, digits, key, word, other, name, sign = (F.col(c) for c in ("b64", "digits", "key", "word", "other", "name", "sign"))
    tail = F.when(sign.endswith('"'), F.lit('"')).otherwise(F.lit(""))
    kinds = [
        (1, F.concat(word, F.lit(" "), key, sign, F.substring(h, 1, 40), tail, F.lit(" "), word)),
        (1, F.concat(word, F.lit(" "), F.upper(key), sign, F.upper(F.substring(h, 1, 32)), tail, F.lit(" "), word)),
        (1, F.concat(key, sign, F.substring(b64, 1, 40), tail)),
        (1, F.concat(word, F.lit(" "), key, sign, F.lit("AKIA"), F.upper(F.substring(h, 9, 16)), tail, F.lit(" "), word)),
        (1, F.concat(word, F.lit(" "), key, F.lit("="), F.substring(h, 1, 18), F.lit(" "), word)),
        (1, F.concat(F.lit("Authorization: Bearer "), F.substring(b64, 1, 44))),
        (1, F.concat(word, F.lit(" "), F.lit("ghp_"), F.substring(b64, 1, 36), F.lit(" "), word)),
        (1, F.concat(word, F.lit(" "), key, sign, F.substring(b64, 1, 10), tail, F.lit(" "), word)),
        (1, F.concat(key, sign, F.translate(F.substring(h, 1, 12), "0123456789", "qwrtzkxvjm"), tail)),
        (0, F.concat(word, F.lit(" "), key, sign, F.col("plain"), tail, F.lit(" "), word)),
        (0, F.concat(other, F.lit(" "), F.substring(h, 1, 40), F.lit(" "), word)),
        (0, F.concat(word, F.lit(" "), other, sign, F.substring(h, 1, 64), tail)),
        (0, F.concat(word, F.lit(" "), F.substring(digits, 1, 16), F.lit(" "), word)),
        (0, F.concat(key, F.lit(" "), word, F.lit(" "), F.substring(digits, 1, 16), F.lit(" "), word)),
        (0, F.concat(F.lit("id: "), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(" "), word)),
        (0, F.concat(word, F.lit(" "), name, F.substring(digits, 1, 3), name, F.lit("_"), F.substring(digits, 4, 2), F.lit(" "), word)),
        (0, F.concat(key, F.lit(" in /static/"), name, F.lit("/"), name, F.substring(digits, 1, 2), F.lit("/index "), word)),
        (0, F.concat(word, F.lit(" "), key, F.lit(" = "), F.lit("example-"), name, F.lit("-0000000"), F.lit(" "), word)),
        (0, F.concat(word, F.lit(" "), other, F.lit(" "), word, F.lit(" "), F.substring(h, 1, 32), F.lit(" "), word)),
        (0, F.concat(other, F.lit(": "), F.upper(F.substring(h, 1, 40)))),
        (0, F.concat(word, F.lit(" "), other, F.lit(" "), F.substring(h, 1, 64), F.lit(" "), word)),
        (0, F.concat(other, sign, F.lit("release-"), F.substring(digits, 1, 4), F.lit("-"), F.substring(digits, 5, 6), tail)),
    ]
    kind = F.conv(F.substring(h, 90, 4), 16, 10).cast("int") % len(kinds)
    shaped = None
    for i, (y, t) in enumerate(kinds):
        own = base.filter(kind == i).select("id", t.alias("text"), "path", F.lit(y).alias("label"), F.lit(i).alias("family"))
        shaped = own if shaped is None else shaped.unionAll(own)
    return cut(shaped)  # else what follows would be planned once for each shape


def fit(labelled: DataFrame, trees: int = 20, depth: int = 7) -> RandomForestClassificationModel:
    """``labelled``: (id, text, path, label), of a size that one machine holds (LABELLED_ROWS by default)."""
    rows = with_features(candidates(labelled, "id", "text", "path")).join(labelled.select("id", F.col("label").cast("double").alias("label")), "id")
    rows = cut(rows.select("label", *FEATURES).coalesce(1))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11, featuresCol="features").fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))


def scan(docs: DataFrame, model: RandomForestClassificationModel, id_col: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """All candidates with ``score`` (0 to 1) and ``is_secret``."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(candidates(docs, id_col, text, path)))
    p = F.get(vector_to_array("probability"), F.lit(1))
    return model.transform(rows).withColumn("score", p).withColumn("is_secret", F.col("score") >= THRESHOLD).drop("features", "rawPrediction", "probability", "prediction", *FEATURES)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"), fit(labelled_findings(spark)))
    return found.select(F.col("id").alias("doc_id"), "pos", F.sha2("candidate", 256).alias("candidate_sha256"), F.length("candidate").cast("long").alias("length"), F.round("score", 6).alias("score"), "is_secret")
