"""Secrets in texts: candidates by shape, false positives removed by a random forest. DataFrame functions and Spark's own trees only.

A candidate is a long run of key characters with a digit, an assignment or mixed case in it or all of capitals, what is assigned to a
secret's name from 8 characters on, whatever they are, or a private key block; a published key inside a run is a value of its own. The forest sees its length,
the transitions between character classes, how much of its letters are words of the corpus, whether it belongs to a path, address or
link, and the words before it. It is trained on labelled findings; without given ones, those that a strict rule is sure
of (:func:`sure_label`): known key formats and assignments to a secret's name, against addresses, links, paths and plain words.

At most ``TRAIN_FINDINGS`` labelled findings train the forest; the corpus words are counted over all documents, and every finding
is judged. The same candidate twice in a document is one finding, and so are those of rows that repeat its id and text.

Null and empty texts have no findings; documents are told apart by id and text; when all labels agree, every finding has that label;
an empty table has no findings.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import write_table

MIN_RUN = 14
TRAIN_FINDINGS = 8000
TREES, DEPTH = 30, 6
COMMON, COMMON_SHARE = 3, 1e-5  # different texts, and share of them, from which a word counts as one of the corpus
LONGEST_WORD = 40  # letters; longer runs are no words of a dictionary
MARK = "[SECRET]"
LEFT = 48  # characters of the text before a candidate
STRIDE = 256  # matches whose lengths are summed at once
_KEY = r"[A-Za-z0-9+/_=.@:~-]"
_BLOCK = r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"
# Letters in lower case or capitalised with white space or punctuation on both sides; what touches a digit or key character is no word.
_TOUCH = r"[\p{L}\p{N}+/_=@~:.-]"
WORD = rf"(?<!{_TOUCH})[A-Za-z][a-z]{{2,{LONGEST_WORD - 1}}}+(?=[.:]*+(?!{_TOUCH}))"
CANDIDATE = rf"{_BLOCK}|(?<!{_KEY}){_KEY}{{{MIN_RUN},}}+"
SECRET_NAME = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential|client[_-]?key)"
_NAME = r"^(?:[A-Za-z_.-]{2,40}[=:]+|[A-Za-z_][A-Za-z0-9_.-]{1,39}=+)"
#: A secret's name, an assignment, and a value of MIN_NAMED characters, in quotes (group 2) or not (group 3).
MIN_NAMED = 8
_SIMPLE = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential|client[_-]?key)"
NAMED = rf"(?i)(?=[pstabc]){_SIMPLE}[\w-]{{0,16}}[\"']?\s{{0,3}}[=:]{{1,2}}\s{{0,3}}(?:([\"'])([^\"'\s]{{{MIN_NAMED},}}+)\1|((?:{_KEY}|[!#$%^&*]){{{MIN_NAMED},}}+))"
#: Formats that issuers publish.
KNOWN_FORMATS = (
    r"^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[0-9A-Za-z]{36}|^github_pat_|^xox[abprs]-|^sk_live_|^sk-[0-9A-Za-z]{20}"
    r"|^AIza[0-9A-Za-z_-]{35}|^eyJ[0-9A-Za-z_-]+\.eyJ|^glpat-|^-----BEGIN"
)
#: The same inside a run, each as far as it goes.
KNOWN_INSIDE = (
    r"(?<![0-9A-Za-z])(?:(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[0-9A-Za-z]{36,}|github_pat_\w+|xox[abprs]-[0-9A-Za-z-]+|sk_live_\w+"
    r"|sk-[0-9A-Za-z]{20,}|AIza[0-9A-Za-z_-]{35}|eyJ[0-9A-Za-z_-]+\.eyJ[0-9A-Za-z_.-]+|glpat-[0-9A-Za-z_-]+)"
)
ADDRESS = r"@|://|^www\.|\.[a-z]{2,4}$|^(\.{0,2}/)?[A-Za-z0-9_.-]+/[A-Za-z0-9_./-]+$"
FEATURES = [
    "length", "digits", "uppers", "marks", "transitions", "variety", "hex", "coverage", "longest_word",
    "path", "named", "assigned", "quoted", "neighbour_length", "neighbour_capital",
]
PLACE = ["doc_id", "text_key", "run", "value"]  # what tells findings apart


def _share(value: Column, keep: str) -> Column:
    return F.length(F.regexp_replace(value, f"[^{keep}]+", "")) / F.greatest(F.length(value), F.lit(1))


def _plain(run: Column) -> Column:
    """A run without what does not belong to its value: a name in front (password=...) and closing marks."""
    plain = F.regexp_replace(F.regexp_replace(run, _NAME, ""), r"[.:@]+$", "")
    return F.when(run.rlike("^-----BEGIN") | (F.length(plain) == 0), run).otherwise(plain)


def _found(run: Column) -> Column:
    """The values in a run: each published key where the whole is none, else what is left of the run."""
    keys = F.array_distinct(F.regexp_extract_all(run, F.lit(KNOWN_INSIDE), F.lit(0)))
    return F.when(~_plain(run).rlike(KNOWN_FORMATS) & (F.size(keys) > 0), keys).otherwise(F.array(_plain(run)))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row, however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _places(text: str, pattern: str) -> Column:
    """All matches of a pattern with the place of each, from 1, and the text before it: structs match, at, left.

    The matches and the texts between them are found in two passes. Places are sums of their lengths: of whole
    strides before a match's own stride, and of the matches in it.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), matches.alias("matches"))

    def total(numbers: Column, start, count) -> Column:
        return F.aggregate(F.slice(numbers, start, count), F.lit(0).cast("long"), lambda a, x: a + x)

    def strides(lengths: Column) -> Column:
        whole = F.transform(F.sequence(F.lit(0), F.size(lengths) - 1, F.lit(STRIDE)), lambda i: total(lengths, i + 1, F.lit(STRIDE)))
        return _let(whole, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: total(w, F.lit(1), i)))

    def each(p: Column, lengths: Column, before: Column, i: Column) -> Column:
        stride = F.floor(i / STRIDE).cast("int")
        at = before[stride] + total(lengths, stride * STRIDE + 1, i - stride * STRIDE) + F.length(p.gaps[i]) + 1
        # A match and its gap are 12 characters or more, so four of them fill the text to the left.
        near = [x for k in range(4, 0, -1) for x in (F.get(p.gaps, i - k), F.get(p.matches, i - k))] + [p.gaps[i]]
        left = F.concat(*(F.right(F.coalesce(x, F.lit("")), F.lit(LEFT)) for x in near))
        return F.struct(p.matches[i].alias("match"), at.alias("at"), F.right(left, F.lit(LEFT)).alias("left"))

    def placed(p: Column) -> Column:
        lengths = F.zip_with(F.slice(p.gaps, F.lit(1), F.size(p.matches)), p.matches, lambda g, m: F.length(g) + F.length(m))
        rows = _let(lengths, lambda n: _let(strides(n), lambda w: F.transform(F.sequence(F.lit(0), F.size(n) - 1), lambda i: each(p, n, w, i))))
        return F.when(F.size(p.matches) > 0, rows)

    return _let(parts, placed)


def candidates(docs: DataFrame) -> DataFrame:
    """One row a document (id and text) and different candidate, with the value inside it, its first place and the text before that."""
    shape = "[0-9=]|^[A-Z]{16,}[.:]*$|[a-z][A-Z]|[A-Z]{2}[a-z]"
    long_run = F.exists(F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)), lambda x: x.rlike(shape) | x.rlike(KNOWN_INSIDE))
    # Only texts with a candidate are cut.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(long_run | F.col("text").rlike(NAMED))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_key"), _places("text", CANDIDATE).alias("runs"), _places("text", NAMED).alias("behind"))
    both = F.concat(
        F.transform(F.coalesce("runs", F.array()), lambda x: F.struct(F.lit(0).alias("kind"), x.match.alias("match"), x.at.alias("at"), x.left.alias("left"))),
        F.transform(F.coalesce("behind", F.array()), lambda x: F.struct(F.lit(1).alias("kind"), x.match.alias("match"), x.at.alias("at"), x.left.alias("left"))),
    )
    each = rows.select("doc_id", "text_key", F.explode(both).alias("x")).select("doc_id", "text_key", "x.*")
    each = each.where((F.col("kind") == 1) | F.col("match").rlike(shape) | F.col("match").rlike(KNOWN_INSIDE))
    # Behind a name, the run is what is assigned, in quotes or not; the name belongs to the text before it.
    quoted, plain = (F.regexp_extract("match", NAMED, i) for i in (2, 3))
    run = F.when(F.col("kind") == 0, F.col("match")).otherwise(F.when(quoted != "", quoted).otherwise(plain))
    closing = F.when((F.col("kind") == 1) & (quoted != ""), 1).otherwise(0)
    each = each.withColumn("run", run).withColumn("lead", F.length("match") - F.length("run") - closing)
    left = F.when(F.col("kind") == 0, F.col("left")).otherwise(F.right(F.concat("left", F.expr("left(match, lead)")), F.lit(LEFT)))
    each = each.select("doc_id", "text_key", "kind", "run", (F.col("at") + F.col("lead")).alias("position"), left.alias("left_text"))
    each = each.select("*", F.explode(_found(F.col("run"))).alias("value")).where(F.length("value") >= MIN_NAMED)
    first = F.min(F.struct("kind", "position", "left_text")).alias("first")
    found = each.groupBy("doc_id", "text_key", "run", "value").agg(first).select("doc_id", "text_key", "run", "value", "first.*")
    # What is a candidate by its shape is one already.
    shaped = F.min("kind").over(Window.partitionBy("doc_id", "text_key", "value"))
    return found.withColumn("shaped", shaped).where(F.col("kind") == F.col("shaped")).drop("kind", "shaped")


def described(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The candidates with the features that the forest sees."""
    value, run = F.col("value"), F.col("run")
    kinds = value
    for pattern, mark in (("[0-9]+", "9"), ("[a-z]+", "a"), ("[A-Z]+", "A"), ("[^0-9a-zA-Z]+", "-")):
        kinds = F.regexp_replace(kinds, pattern, mark)
    name = F.regexp_extract("run", _NAME, 0)
    before = F.regexp_extract("left_text", r"(\S+)(?:\s+\S{1,3})?\s*$", 1)
    near = F.concat_ws(" ", F.regexp_extract("left_text", r"((?:\S+\s+){0,3}\S*)$", 1), name)
    found = found.withColumns(
        {
            "length": F.log1p(F.length(value)),
            "digits": _share(value, "0-9"),
            "uppers": _share(value, "A-Z"),
            "marks": 1 - _share(value, "0-9a-zA-Z"),
            "transitions": F.length(kinds) / F.length(value),
            "variety": F.size(F.array_distinct(F.split(value, ""))) / F.least(F.length(value), F.lit(64)),
            "hex": value.rlike("^[0-9a-fA-F]+$").cast("int"),
            "path": run.rlike(ADDRESS).cast("int"),
            "named": near.rlike(SECRET_NAME).cast("int"),
            "assigned": (run.rlike(_NAME) | F.col("left_text").rlike("[=:]\\s*[\"']?$")).cast("int"),
            "quoted": F.col("left_text").rlike("[\"']$").cast("int"),
            "neighbour_length": F.length(before),
            "neighbour_capital": before.rlike("^[A-Z]").cast("int"),
            "parts": F.regexp_extract_all(F.lower(value), F.lit("[a-z]{3,}"), F.lit(0)),
        }
    )
    found = write_table(found, "candidates")
    return write_table(_with_coverage(found, docs), "findings")


def _with_coverage(found: DataFrame, docs: DataFrame) -> DataFrame:
    """How much of a value are words that stand alone in the corpus, and the longest of them."""
    parts = found.select(F.explode(F.array_distinct("parts")).alias("word")).distinct()
    # Copies of a text count once.
    each = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lower))
    texts = docs.where("text IS NOT NULL").select(F.xxhash64("text").alias("text_key"), each.alias("words")).dropDuplicates(["text_key"])
    enough = max(COMMON, COMMON_SHARE * docs.agg(F.approx_count_distinct(F.xxhash64("text"))).first()[0])
    # Counted before the join, so that a word that is very frequent is one row of it.
    words = texts.select(F.explode("words").alias("word")).groupBy("word").count()
    known = words.where(F.col("count") >= enough).join(parts, "word", "left_semi").select("word")
    each = found.select("doc_id", "text_key", "run", "value", F.explode("parts").alias("word")).join(known, "word")
    covered = each.groupBy("doc_id", "text_key", "run", "value").agg(F.sum(F.length("word")).alias("letters"), F.max(F.length("word")).alias("longest_word"))
    covered = covered.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), F.col("run").alias("r"), F.col("value").alias("v"), "letters", "longest_word")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")) & (F.col("run") == F.col("r")) & (F.col("value") == F.col("v"))
    coverage = F.coalesce(F.col("letters"), F.lit(0)) / F.length("value")
    return (
        found.join(covered, same, "left")
        .withColumns({"coverage": coverage, "longest_word": F.coalesce("longest_word", F.lit(0))})
        .drop("d", "k", "r", "v", "letters", "parts")
    )


def sure_label() -> Column:
    """1 or 0 where a strict rule is sure of a finding, else null."""
    random_like = (F.length("value") >= 16) & (F.col("digits") >= 0.15) & (F.col("marks") <= 0.1) & (F.col("path") == 0)
    given = (F.col("named") == 1) & (F.col("assigned") == 1) & (F.col("path") == 0) & (F.col("digits") < 1)
    # Behind a name, letters that are no words, of either case or with digits among them, are enough; words alone are not.
    mixed = F.col("value").rlike("[0-9]|[a-z][A-Z]") & F.col("value").rlike("[A-Za-z]") & (F.col("coverage") < 0.5)
    secret = F.col("value").rlike(KNOWN_FORMATS) | (given & (random_like | mixed))
    other = (F.col("path") == 1) | (F.col("digits") == 1) | ((F.col("named") == 0) & (F.col("coverage") >= 0.5)) | ((F.col("named") == 0) & (F.col("digits") <= 0.1))
    other |= (F.col("digits") == 0) & (F.col("coverage") >= 0.9)
    return F.when(secret, 1).when(other, 0)


def judge(found: DataFrame, labelled: DataFrame) -> DataFrame:
    """Findings with the forest's score; ``labelled``: described findings with a label of 0 or 1."""
    known = labelled.where(F.col("label").isin(0, 1)).select(*FEATURES, *PLACE, F.col("label").cast("double").alias("label"))
    draw = F.pmod(F.xxhash64(*FEATURES, *PLACE), F.lit(1 << 20))
    counts = {int(r.label): r["count"] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return found.withColumn("score", F.lit(float(next(iter(counts), 0))))
    limits = [F.lit(min(1.0, TRAIN_FINDINGS / 2 / counts[k]) * (1 << 20)) for k in (0, 1)]
    chosen = known.where(draw < F.when(F.col("label") == 1, limits[1]).otherwise(limits[0])).select(*FEATURES, "label")
    chosen = write_table(chosen.orderBy("label", *FEATURES).coalesce(1), "labelled")  # bounded; one order, so one forest
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=5).fit(assemble.transform(chosen).coalesce(1))
    scored = forest.transform(assemble.transform(found))
    return scored.withColumn("score", F.element_at(vector_to_array("probability"), 2)).drop("features", "rawPrediction", "probability", "prediction")


def find_secrets(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """One row a finding: doc_id, text_key, run (as it stands), value, position (from 1), score, is_secret."""
    found = described(candidates(docs), docs)
    scored = judge(found, found.withColumn("label", sure_label()) if labelled is None else labelled)
    # A published format needs no forest to be believed.
    secret = (F.col("score") >= threshold) | F.col("value").rlike(KNOWN_FORMATS)
    return scored.select("doc_id", "text_key", "run", "value", "position", "score", secret.alias("is_secret"))


def without_secrets(docs: DataFrame) -> DataFrame:
    """All documents, with every secret replaced by a mark and the length adjusted; other documents are unchanged."""
    secrets = find_secrets(docs).where("is_secret").groupBy(F.col("doc_id").alias("sd"), F.col("text_key").alias("sk"))
    # The different secrets of one document; longer ones first, so that none leaves the rest of another.
    held = write_table(secrets.agg(F.sort_array(F.collect_set(F.struct(F.length("value").alias("n"), "value")), asc=False).alias("held")), "secrets")
    whole = docs.select(F.struct("*").alias("d"))  # so that no column of the documents meets one of the findings
    text, id_ = F.col("d.text"), F.col("d.doc_id").cast("long")
    clean = F.aggregate("held", text, lambda t, s: F.replace(t, s.value, F.lit(MARK)))
    joined = whole.join(held, id_.eqNullSafe(F.col("sd")) & (F.xxhash64(text) == F.col("sk")), "left")
    joined = joined.select("d", F.col("held").isNotNull().alias("found"), F.when(F.col("held").isNotNull(), clean).otherwise(text).alias("cleaned"))
    changed = {"text": F.col("cleaned"), "n_chars": F.when(F.col("found"), F.length("cleaned")).otherwise(F.col("d.n_chars"))}
    return joined.select(*[changed.get(c, F.col("d")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
