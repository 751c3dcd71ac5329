"""Secret candidates judged by a random forest; DataFrame and SQL functions and Spark ML only.

Runs of key-like characters, and all values assigned to a key word, are candidates. Each is described by its length, the changes between kinds of
characters, how much of it the dictionary of the texts covers, the path it stands in and the words beside it.
A forest trained from labelled findings tells secrets from false positives.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnograph.llm.common import col
from limnograph.session import scratch_path

KEY_WORDS = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api.?key|access.?key|auth|bearer|credentials?|private.?key)"
_KEY = "[A-Za-z0-9_+/-]"
#: A value of any length and form right behind a key word and ``=`` or ``:`` ends at white space, a quote, a comma or the like.
_ASSIGNED = (r"(?<=[=:\s\"'`])(?<=[=:][\s\"'`]{0,3})(?<=(?i:" + KEY_WORDS + r")[\"'`]?\s{0,2}[=:][\s\"'`]{0,3})"
             r"[^\s\"'`<>,;]*[^\s\"'`<>,;.:!?()\[\]{}]")
#: Elsewhere, eight or more key-like characters with a digit, or sixteen or more without; letters beyond ASCII may touch them.
_PLAIN = rf"(?<!{_KEY})(?:(?=[A-Za-z_+/-]*+[0-9]){_KEY}{{8,}}|[A-Za-z_+/-]{{16,}})={{0,2}}(?!{_KEY})"
CANDIDATE = f"{_ASSIGNED}|{_PLAIN}"
_BESIDE = 48
_BLOCK = 256
MASK = "[SECRET]"

FEATURES = ("length", "upper", "lower", "digits", "others", "hex_share", "distinct_share", "kind_changes",
            "vowel_changes", "dictionary", "slashes", "after_slash", "before_dot", "test_path", "key_word_before",
            "key_word_near", "assigned", "quoted", "word_after")


@dataclass(frozen=True)
class Training:
    """Bounds of the training: labelled findings of each kind (by a hash of the candidate), contexts for planted ones, trees, their depth, the share
    of the documents that a dictionary word must be in, and the least probability of a secret."""

    findings: int = 10_000
    contexts: int = 10_000
    trees: int = 20
    depth: int = 6
    dictionary_share: float = 0.002
    least: float = 0.5
    seed: int = 11


def _running(lengths: str) -> str:
    """SQL for the sums of the entries before each entry of an array, block by block so that long arrays stay cheap."""
    grow = "(acc, x) -> named_struct('a', array_append(acc.a, acc.s), 's', acc.s + x)"
    part = f"slice({lengths}, b * {_BLOCK} + 1, {_BLOCK})"
    blocks = f"sequence(0L, CAST((size({lengths}) - 1) DIV {_BLOCK} AS BIGINT))"
    sums = f"transform({blocks}, b -> aggregate(slice({lengths}, CAST(b AS INT) * {_BLOCK} + 1, {_BLOCK}), 0L, (s, x) -> s + x))"
    zero = "named_struct('a', CAST(array() AS ARRAY<BIGINT>), 's', {})"
    starts = f"aggregate({sums}, {zero.format('0L')}, {grow}).a"
    return (f"flatten(transform({starts}, (s, b) -> aggregate({part}, {zero.format('s')}, {grow}).a))")


def candidates(docs: DataFrame, text: str = "text", path: str | None = None, doc_id: str = "doc_id") -> DataFrame:
    """Every candidate of the whole texts: ``row_key``, ``doc_id``, ``nth`` (from 0), ``start`` (code points), ``candidate``,
    ``before``, ``after`` (up to 48 characters beside it) and ``path``.

    Rows with equal id and text have one ``row_key`` and their candidates come once. NULL and empty texts have none.
    """
    rows = docs.select(col(doc_id).alias("doc_id"), col(text).cast("string").alias("text"),
                       (F.coalesce(col(path).cast("string"), F.lit("")) if path else F.lit("")).alias("path")) \
        .where(F.col("text").rlike(CANDIDATE))
    cut = rows.select(row_key(F.col("doc_id"), F.col("text")).alias("row_key"), "doc_id", "path",
                      F.split("text", CANDIDATE, -1).alias("gaps"),
                      F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"))
    cut = cut.withColumn("lengths", F.expr("transform(found, (c, i) -> CAST(length(gaps[i]) + length(c) AS BIGINT))"))
    cut = cut.withColumn("sums", F.expr(_running("lengths")))
    every = F.expr(f"""transform(found, (c, i) -> named_struct(
        'nth', i, 'start', sums[i] + length(gaps[i]), 'candidate', c,
        'before', right(gaps[i], {_BESIDE}), 'after', left(gaps[i + 1], {_BESIDE})))""")
    return cut.select("row_key", "doc_id", "path", F.explode(every).alias("c")) \
        .select("row_key", "doc_id", "path", "c.*")


def row_key(doc_id: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("\0", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))), 256)


def dictionary(docs: DataFrame, share: float, text: str = "text") -> list[int]:
    """Letter trigrams of the words that stand in at least ``share`` of all texts, as bits; at most 26 ** 3 of them."""
    n = docs.count()
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(col(text).cast("string")), r"[^a-z]+"))).alias("word")) \
        .where(F.length("word") >= 3).groupBy("word").count().where(F.col("count") >= share * n)
    letters = F.expr("explode(transform(sequence(1, length(word) - 2), i -> substr(word, i, 3)))")
    numbers = words.select(letters.alias("t")).distinct().select(
        F.expr("(ascii(t) - 97) * 676 + (ascii(substr(t, 2)) - 97) * 26 + ascii(substr(t, 3)) - 97").alias("n")).collect()
    bits = [0] * (26 ** 3 // 63 + 1)
    for r in numbers:
        bits[r.n // 63] |= 1 << (r.n % 63)
    return bits


def describe(found: DataFrame, trigrams: list[int]) -> DataFrame:
    """``found`` (``candidate``, ``before``, ``after``, ``path``) with the columns of ``FEATURES``; NULLs count as empty."""
    c, before, after, path = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("candidate", "before", "after", "path"))
    n = F.greatest(F.length(c), F.lit(1))
    count = lambda x, p: F.regexp_count(x, F.lit(p)).cast("double")
    is_ = lambda x, p: x.rlike(p).cast("double")
    table = "array(" + ", ".join(f"{b}L" for b in trigrams) + ")"
    covered = F.expr(f"""aggregate(sequence(1, greatest(length(low) - 2, 1)), 0, (s, i) -> s + coalesce(
        CASE WHEN substr(low, i, 3) RLIKE '^[a-z]{{3}}$' THEN CAST(getbit({table}[
            ((ascii(substr(low, i, 1)) - 97) * 676 + (ascii(substr(low, i + 1, 1)) - 97) * 26 + ascii(substr(low, i + 2, 1)) - 97) DIV 63],
            ((ascii(substr(low, i, 1)) - 97) * 676 + (ascii(substr(low, i + 1, 1)) - 97) * 26 + ascii(substr(low, i + 2, 1)) - 97) % 63) AS INT)
        END, 0)) / greatest(length(low) - 2, 1)""")
    vowel, other = "[aeiou]", "[b-df-hj-np-tv-z]"
    new = {
        "length": F.length(c).cast("double"),
        "upper": count(c, "[A-Z]") / n, "lower": count(c, "[a-z]") / n, "digits": count(c, "[0-9]") / n,
        "others": count(c, "[^A-Za-z0-9]") / n, "hex_share": count(c, "[0-9A-Fa-f]") / n,
        "distinct_share": F.size(F.array_distinct(F.split(c, ""))).cast("double") / n,
        "kind_changes": count(c, "(?<=[a-z])(?![a-z])|(?<=[A-Z])(?![A-Z])|(?<=[0-9])(?![0-9])") / n,
        "vowel_changes": count(F.lower(c), f"(?<={vowel})(?={other})|(?<={other})(?={vowel})") / n,
        "dictionary": covered,
        "slashes": count(c, "/"),
        "after_slash": is_(before, r"(?:/|://\S*|[\w.-]/\S*)$"), "before_dot": is_(after, r"^[./]\w"),
        "test_path": is_(F.lower(path), "test|example|sample|demo|fixture|mock|doc"),
        "key_word_before": is_(F.lower(before), KEY_WORDS + r"\W{0,6}$"), "key_word_near": is_(F.lower(before), KEY_WORDS),
        "assigned": is_(before, r"[=:]\s*[\"']?$"),
        "quoted": (before.rlike(r"[\"'`]$") & after.rlike(r"^[\"'`]")).cast("double"),
        "word_after": is_(after, r"^\W{0,3}\p{L}"),
    }
    out = found.withColumn("low", F.lower(c))
    for name in FEATURES:
        out = out.withColumn(name, F.coalesce(new[name].cast("double"), F.lit(0.0)))
    return out.drop("low")


def train(labelled: DataFrame, training: Training = Training()) -> RandomForestClassificationModel | float:
    """A forest from described findings with ``label`` (1 a secret, 0 a false positive; NULLs are left out).

    At most ``Training.findings`` of each kind are used, those with the smallest hashes. Where one kind is
    missing there is nothing to tell apart, and the share of secrets (1 or 0; 0 without any) is returned.
    """
    code = F.xxhash64("candidate", "before", "after")
    kinds = [labelled.where(F.col("label") == k).select("label", *FEATURES, code.alias("code"))
             .orderBy("code", *FEATURES).limit(training.findings).drop("code") for k in (0, 1)]
    n_false, n_true = (k.count() for k in kinds)
    if not n_false or not n_true:
        return 1.0 if n_true else 0.0
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(kinds[0].unionByName(kinds[1]))
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=training.trees,
                                    maxDepth=training.depth, seed=training.seed)
    return forest.fit(rows.select("features", F.col("label").cast("double").alias("label")))


def judge(described: DataFrame, model: RandomForestClassificationModel | float, training: Training = Training()) -> DataFrame:
    """Described findings with ``probability`` and ``is_secret``; features are dropped again."""
    if isinstance(model, float):
        out = described.withColumn("probability", F.lit(model))
    else:
        rows = VectorAssembler(inputCols=list(FEATURES), outputCol="__features").transform(described)
        model = model.copy().setFeaturesCol("__features").setPredictionCol("").setRawPredictionCol("").setProbabilityCol("__p")
        out = model.transform(rows).withColumn("probability", vector_to_array("__p")[1]).drop("__features", "__p")
    return out.withColumn("is_secret", F.col("probability") >= training.least).drop(*FEATURES)


def format_label() -> Column:
    """1 for keys of an exact format, 0 for what cannot be one, else NULL: a check of what a forest finds, not used to train it.

    Ones: an access key id (``AKIA`` and sixteen capitals or digits), and a value of 20 or more hex digits or of
    mixed letters and digits that is assigned to a key word. Zeros: letters only without a key word beside, and digits only.
    """
    c, before = F.col("candidate"), F.lower(F.col("before"))
    assigned = before.rlike(KEY_WORDS + r"\s*[=:]\s*[\"']?$")
    return F.when(c.rlike("^AKIA[A-Z0-9]{16}$"), 1) \
        .when(assigned & (c.rlike("^[0-9a-fA-F]{20,}$") | c.rlike("^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9]{8,}$")), 1) \
        .when(c.rlike("^[A-Za-z]+$") & ~before.rlike(KEY_WORDS), 0) \
        .when(c.rlike("^[0-9]+$"), 0)


#: What stands before planted findings. The last of the first list is for keys that need no key word.
_LEADS = ['token = "', "api_key: ", "password=", "secret_key = '", "Authorization: Bearer ", ""]
_OTHER_LEADS = ["", "commit ", "id: ", "https://host.org/item/", "sha1 = ", "no. "]
_PLAIN_WORDS = "some plain words that stand for the text of a document without any"
_BLANK_CONTEXTS = 400


def planted(found: DataFrame, training: Training = Training()) -> DataFrame:
    """Labelled findings, one key and one look-alike for each context: ``candidate``, ``before``, ``after``, ``path``, ``label``,
    ``held_out`` (a quarter of the contexts).

    Contexts are the surroundings of at most ``Training.contexts`` candidates of ``found`` that no key word precedes (by
    a hash of them), and a fixed number of blank ones. Keys are access key ids, hex, alphanumeric and base64 strings, prefixed
    tokens and short passwords behind a key word. Look-alikes are joined words (a third in capitals), numbers, UUIDs, commit hashes, paths, and words
    behind a key word. All are drawn by hashes of their contexts.
    """
    spark = found.sparkSession
    around = found.where(~F.lower(F.col("before")).rlike(KEY_WORDS)).select("before", "after", "path") \
        .groupBy("before", "after").agg(F.min("path").alias("path")).withColumn("h", F.xxhash64("before", "after")) \
        .orderBy("h", "before", "after").limit(training.contexts)
    blank = spark.range(_BLANK_CONTEXTS).select(F.lit("").alias("before"), F.lit("").alias("after"), F.lit("").alias("path"), F.xxhash64("id").alias("h"))
    rows = around.unionByName(blank).withColumn("x", F.sha2(F.col("h").cast("string"), 512)) \
        .withColumn("b", F.base64(F.unhex("x"))).withColumn("s", F.regexp_replace("b", "[^A-Za-z0-9]", "")) \
        .withColumn("d", F.translate("x", "abcdef", "012345")) \
        .withColumn("w", F.regexp_replace(F.concat("before", "after", F.lit(_PLAIN_WORDS)), "[^A-Za-z]", ""))
    kind, turn = F.pmod(F.shiftright("h", 8), F.lit(6)), F.pmod(F.shiftright("h", 16), F.lit(6))
    some = lambda least, spread, at: F.lit(least) + F.pmod(F.shiftright("h", at), F.lit(spread)).cast("int")
    cut = lambda c, start, n: F.substr(F.col(c), F.lit(start), n if isinstance(n, Column) else F.lit(n))
    pick = lambda values, at: F.element_at(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), (at + 1).cast("int"))
    key = pick([F.concat(F.lit("AKIA"), F.upper(cut("s", 1, 16))), cut("x", 1, some(32, 9, 20)), cut("s", 1, some(20, 21, 20)),
                F.concat(F.lit("ghp_"), cut("s", 1, 36)), cut("b", 1, some(32, 13, 20)),
                F.concat(F.lower(F.regexp_replace(cut("s", 1, some(4, 5, 20)), "[0-9]", "k")), cut("d", 1, some(1, 4, 24)))], kind)
    lead = pick(_LEADS, F.when(kind == 5, F.pmod(turn, F.lit(5))).otherwise(turn))
    joined = cut("w", 1, some(16, 9, 20))
    alike = pick([F.when(F.pmod(F.shiftright("h", 28), F.lit(3)) == 0, F.upper(joined)).otherwise(joined), cut("d", 1, some(8, 13, 20)),
                  F.concat_ws("-", cut("x", 1, 8), cut("x", 9, 4), cut("x", 13, 4), cut("x", 17, 4), cut("x", 21, 12)),
                  cut("x", 1, 40), F.concat_ws("/", cut("w", 1, 5), cut("w", 6, some(3, 6, 20)), F.concat(cut("w", 12, 4), cut("d", 1, 2))),
                  F.lower(cut("w", 1, some(3, 7, 20)))], kind)
    # Joined words and numbers stand in running text; hashes and paths behind words of their own; plain words behind key words.
    other = F.when(kind < 2, pick(["", "", "", "", "id: ", "no. "], turn)).when(kind == 5, pick(_LEADS[:5], F.pmod(turn, F.lit(5)))) \
        .otherwise(pick(_OTHER_LEADS, turn))
    end = lambda start: F.when(start.endswith("\""), "\"").when(start.endswith("'"), "'").otherwise("")
    entry = lambda candidate, start, label: F.struct(
        candidate.alias("candidate"), F.right(F.concat("before", F.lit(" "), start), F.lit(_BESIDE)).alias("before"),
        F.left(F.concat(end(start), F.lit(" "), "after"), F.lit(_BESIDE)).alias("after"), F.lit(label).alias("label"))
    return rows.select("path", (F.pmod("h", F.lit(4)) == 2).alias("held_out"),
                       F.explode(F.array(entry(key, lead, 1), entry(alike, other, 0))).alias("e")).select("path", "held_out", "e.*")


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, training: Training = Training(), text: str = "text",
                 path: str | None = "source", doc_id: str = "doc_id") -> DataFrame:
    """All candidates of all ``docs`` with ``probability`` and ``is_secret``; columns as of ``candidates``.

    ``labelled`` has ``candidate``, ``before``, ``after``, ``path`` and ``label``; without it, the forest learns from findings
    planted into the surroundings of candidates (``planted``, but for those held out). The dictionary is counted over all
    texts. Of rows with equal id and text, the smallest path counts. Candidates are written once to the folder of
    ``spark.checkpoint.dir``. Without documents there are no rows.
    """
    spark = docs.sparkSession
    place = scratch_path(spark, "candidates")
    every = candidates(docs, text, path if path in docs.columns else None, doc_id)
    every.groupBy("row_key", "nth").agg(*[(F.min if c == "path" else F.first)(c).alias(c) for c in every.columns
                                          if c not in ("row_key", "nth")]).select(*every.columns).write.parquet(place)
    found = spark.read.parquet(place)
    trigrams = dictionary(docs, training.dictionary_share, text)
    if labelled is None:
        labelled = planted(found, training).where(~F.col("held_out"))
    return judge(describe(found, trigrams), train(describe(labelled, trigrams), training), training)


def mask_secrets(docs: DataFrame, findings: DataFrame, text: str = "text", doc_id: str = "doc_id", mask: str = MASK) -> DataFrame:
    """``docs`` with ``mask`` in place of each finding that is a secret; every row stays, other texts are unchanged."""
    key, hits, at = "__row_key", "__hits", docs.columns
    found = findings.where("is_secret").groupBy(F.col("row_key").alias(key)).agg(F.collect_set("nth").alias(hits))
    rows = docs.withColumn(key, row_key(col(doc_id), col(text))).join(found, key, "left")
    parts, values = F.split(col(text), CANDIDATE, -1), F.regexp_extract_all(col(text), F.lit(CANDIDATE), F.lit(0))
    values = F.transform(values, lambda c, i: F.when(F.array_contains(F.col(hits), i), F.lit(mask)).otherwise(c))
    masked = F.array_join(F.zip_with(parts, values, lambda gap, c: F.concat(gap, F.coalesce(c, F.lit("")))), "")
    return rows.withColumn(text, F.when(F.col(hits).isNotNull(), masked).otherwise(col(text))).select(*map(col, at))
