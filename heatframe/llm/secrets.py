"""Secret scans with a random forest against false positives (operator 7); columns, joins and MLlib only.

Candidates are long runs of letters, digits and a few marks with a digit in them. A random forest trained on labelled
findings judges each by its length, its changes of character class, how much of it dictionary words cover, whether it
lies in a path or address, and the words beside it. The dictionary holds the letter runs of candidates that stand as
whole words in enough different texts of the corpus; pieces of candidates don't count, however often they are copied.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_LENGTH = 12
DICTIONARY_COUNT = 3  # a word of the dictionary stands in so many different texts at least,
DICTIONARY_RATE = 1e-6  # and is this share of all words, each counted once a text
TRAINING_ROWS = 20_000  # labelled findings that the forest is trained on at most, taken by hash
TREES, DEPTH, SEED = 30, 6, 7
BROADCAST_ROWS = 1_000_000
MARK = "<secret>"

_SPACES = "[ \\\\x09-\\\\x0D]+"
_RUN = "[A-Za-z0-9+/_-]"
# a white-space word of letters alone, marks around it left out
_PLAIN_WORD = r"(?<![^ \x09-\x0D])\p{Punct}*+([a-z]{3,})\p{Punct}*+(?![^ \x09-\x0D])"
_ENDS = "\"'`,;&?={}()<>|"  # a value within a word, as a path, ends at these
# what stands before a candidate since the last one, the candidate, and the rest of its value, which is bounded
_CANDIDATE = (f"(?s)(.*?)(?<!{_RUN})((?=[A-Za-z+/_-]*[0-9]){_RUN}{{{MIN_LENGTH},}})(?=([^{_ENDS}]{{0,200}}))")
# Names that stand before a secret, fixed values.
KEY_NAMES = "(?i)(token|passw(or)?d|passwd|secret|api[_-]?key|access[_-]?key|auth|credential|private)"
FEATURES = ["length", "class_changes", "distinct_share", "digit_share", "upper_share", "is_hex", "covered_share",
            "in_path", "in_address", "key_name_before", "assigned", "quoted", "word_before_length"]


def candidates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, word_no, run_no, core, lead, value, before_2, before, after of every candidate.

    Words are runs of anything but white space. Every run of [A-Za-z0-9+/_-] in a word with a digit and at least
    MIN_LENGTH characters is a candidate, ``run_no`` its place among those of the word. ``lead`` is the word's text
    before it back to the last candidate, and that of the first part for parts joined by dots (five at most);
    before_2 and before are the words before, empty where another candidate stands between. ``value`` is the
    candidate with what surrounds it up to quotes, commas and the like. Null and empty texts have none.
    """
    words = f"filter(split(coalesce(`{text_column}`, ''), '{_SPACES}'), w -> w != '')"
    held = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.expr(words).alias("words"))
    places = F.expr(f"filter(sequence(0, size(words)), i -> char_length(get(words, i)) >= {MIN_LENGTH}"
                    " and get(words, i) rlike '[0-9]')")
    near = F.expr("""transform(places, i -> struct(i as word_no, words[i] as word,
        coalesce(get(words, i - 2), '') as before_2, coalesce(get(words, i - 1), '') as before,
        coalesce(get(words, i + 1), '') as after))""")
    found = held.withColumn("places", places).select("doc_id", F.explode(near).alias("c")).select("doc_id", "c.*")
    for k, name in enumerate(("leads", "cores", "rests"), 1):
        found = found.withColumn(name, F.regexp_extract_all("word", F.lit(_CANDIDATE), F.lit(k)))
    own = "i" + "".join(f" - if(i >= {k} and " + " and ".join(f"get(leads, i - {j}) = '.'" for j in range(k)) + ", 1, 0)"
                        for k in range(1, 5))
    runs = F.expr(f"transform(cores, (c, i) -> struct(cast(i as int) as run_no, c as core, {own} as own, get(rests, i) as rest,"
                  f" get(leads, {own}) as lead))")
    each = found.select(
        "doc_id", "word_no", "before_2", "before", "after", F.explode(runs).alias("r")).select(
        "doc_id", "word_no", "before_2", "before", "after", "r.*")
    first = F.col("own") == 0
    value = F.concat(F.regexp_extract("lead", f"[^{_ENDS}]*$", 0), "core", "rest")
    return each.select(
        "doc_id", "word_no", "run_no", "core", "lead", value.alias("value"), F.when(first, F.col("before_2")).otherwise("").alias("before_2"),
        F.when(first, F.col("before")).otherwise("").alias("before"), "after")


def dictionary(docs: DataFrame, found: DataFrame, text_column: str = "text", least: int = DICTIONARY_COUNT,
               rate: float = DICTIONARY_RATE) -> DataFrame:
    """piece: the lower-case letter runs of candidates that are words of the corpus.

    A word is a whole white-space word of three letters or more. It must stand in ``least`` different texts, and in as
    many as ``rate`` times the words of all different texts.
    """
    pieces = found.select(F.explode(_pieces(F.col("core"))).alias("piece")).distinct()
    if pieces.count() <= BROADCAST_ROWS:
        pieces = F.broadcast(pieces)
    spoken = docs.where(F.col(text_column).isNotNull()).select(F.xxhash64(text_column).alias("text_hash"), F.array_distinct(
        F.regexp_extract_all(F.lower(text_column), F.lit(_PLAIN_WORD), F.lit(1))).alias("spoken"))
    all_words = spoken.groupBy("text_hash").agg(F.max(F.size("spoken")).alias("n")).agg(F.sum("n")).first()[0] or 0
    counted = spoken.select("text_hash", F.explode("spoken").alias("piece")).join(pieces, "piece").distinct().groupBy("piece").agg(
        F.count("*").alias("n"))
    return counted.where(F.col("n") >= max(least, rate * all_words)).select("piece")


def _pieces(core: Column) -> Column:
    return F.filter(F.split(F.lower(core), "[^a-z]+"), lambda p: F.char_length(p) >= 3)


def with_features(found: DataFrame, words: DataFrame) -> DataFrame:
    """found with the columns of FEATURES (double); equal cores are looked up once."""
    cores = found.select("core").distinct()
    pieces = cores.select("core", F.explode(_pieces(F.col("core"))).alias("piece"))
    covered = pieces.join(words, "piece").groupBy("core").agg(F.sum(F.char_length("piece")).alias("covered"))
    if covered.count() <= BROADCAST_ROWS:
        covered = F.broadcast(covered)
    core, n, lead = F.col("core"), F.char_length("core"), F.col("lead")
    context = F.concat_ws(" ", "before_2", "before", lead)
    changes = F.regexp_count(core, F.lit(
        "(?<=[0-9])(?=[^0-9])|(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[+/_-])(?=[A-Za-z0-9])"))
    columns = {
        "length": n, "class_changes": changes / n,
        "distinct_share": F.size(F.array_distinct(F.split(core, ""))) / n,
        "digit_share": F.regexp_count(core, F.lit("[0-9]")) / n,
        "upper_share": F.regexp_count(core, F.lit("[A-Z]")) / n,
        "is_hex": core.rlike("^([0-9a-f]+|[0-9A-F]+)$"),
        "covered_share": F.coalesce("covered", F.lit(0)) / n,
        "in_path": F.col("value").rlike("://|^/|/.*/"), "in_address": F.col("value").rlike("@|\\.[a-z]+$"),
        "key_name_before": context.rlike(KEY_NAMES), "assigned": context.rlike("[=:]\\s*[\"'`]?$"),
        "quoted": lead.rlike("[\"'`]$"), "word_before_length": F.char_length("before"),
    }
    return found.join(covered, "core", "left").withColumns(
        {name: c.cast("double") for name, c in columns.items()}).drop("covered")


def weak_labels(featured: DataFrame) -> DataFrame:
    """Labelled findings from candidates whose case is plain: 1.0 for what a key name is assigned and that is no word,
    0.0 for numbers, addresses and paths without a key name; the rest have no label and are left out."""
    plain = F.when((F.col("key_name_before") == 1) & (F.col("assigned") == 1) & (F.col("covered_share") < 0.5), 1.0).when(
        (F.col("key_name_before") == 0) & ((F.col("digit_share") == 1) | (F.col("in_address") == 1) | (F.col("in_path") == 1)
                                           | (F.col("covered_share") >= 0.5)), 0.0)
    return featured.withColumn("label", plain).where("label IS NOT NULL")


def fit_forest(labelled: DataFrame, rows: int = TRAINING_ROWS):
    """The forest, trained on at most ``rows`` distinct labelled findings; None where only one label is there."""
    distinct = labelled.groupBy("core", *FEATURES).agg(F.max("label").alias("label"))
    sample = distinct.orderBy(F.xxhash64("core"), "core", *FEATURES).limit(rows)
    seen = sample.agg(F.min("label"), F.max("label")).first()
    if seen[0] is None or seen[0] == seen[1]:
        return None
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(sample)


def find_secrets(docs: DataFrame, folder: str, labelled: DataFrame | None = None, threshold: float = 0.5,
                 id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, word_no, run_no, core, probability, is_secret of every candidate.

    labelled   findings with the columns of FEATURES, core and label (0.0 or 1.0), from ``with_features``; without them
               the plain cases of ``weak_labels`` are taken. Where they have one label only, that label decides, and
               where there are none, nothing is a secret.
    A text without candidates has no row. Rows with a null id are scanned like any other.
    """
    spark = docs.sparkSession
    candidates(docs, id_column, text_column).write.parquet(f"{folder}/candidates")
    found = spark.read.parquet(f"{folder}/candidates")
    words = dictionary(docs, found, text_column)
    words.write.parquet(f"{folder}/dictionary")
    with_features(found, spark.read.parquet(f"{folder}/dictionary")).write.parquet(f"{folder}/features")
    featured = spark.read.parquet(f"{folder}/features")
    known = weak_labels(featured) if labelled is None else labelled
    model = fit_forest(known)
    if model is None:
        one = known.agg(F.max("label")).first()[0] or 0.0
        judged = featured.withColumn("probability", F.lit(float(one)))
    else:
        judged = model.transform(featured).withColumn("probability", vector_to_array("probability")[1])
    return judged.select("doc_id", "word_no", "run_no", "core", "probability", (F.col("probability") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, folder: str, mark: str = MARK, text_column: str = "text",
           length_column: str | None = "n_chars", **settings) -> DataFrame:
    """docs with every secret of a document replaced by ``mark`` in its text, and its length column counted anew there.

    Documents are known by their texts here, so rows without an id, repeated rows and several texts under one id are
    cleaned like any other. Texts without secrets stay as they are. Columns and their order stay.
    """
    named = docs.select(F.xxhash64(text_column).alias("_named"), F.col(text_column)).where(F.col(text_column).isNotNull())
    found = find_secrets(named, folder, id_column="_named", text_column=text_column, **settings)
    lists = found.where("is_secret").groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_set("core").alias("_secrets"))  # bounded by the text
    lists.write.parquet(f"{folder}/secrets")
    lists = docs.sparkSession.read.parquet(f"{folder}/secrets")
    if (lists.agg(F.sum(F.size("_secrets"))).first()[0] or 0) <= BROADCAST_ROWS:
        lists = F.broadcast(lists)
    # longer ones first, as one may lie in another
    clean = F.expr(f"""aggregate(array_sort(_secrets, (a, b) -> char_length(b) - char_length(a)), `{text_column}`,
        (t, s) -> replace(t, s, '{mark}'))""")
    joined = docs.join(lists, F.xxhash64(docs[text_column]) == F.col("_doc"), "left")
    hit = F.col("_secrets").isNotNull() & F.col(text_column).isNotNull()
    out = joined.withColumn("_clean", F.when(hit, clean).otherwise(F.col(text_column)))
    columns = [F.col("_clean").alias(c) if c == text_column
               else F.when(hit, F.char_length("_clean").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c)
               if c == length_column else docs[c] for c in docs.columns]
    return out.select(*columns)
