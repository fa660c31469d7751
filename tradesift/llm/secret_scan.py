"""Secret scan whose false positives are removed by a random forest, in DataFrame functions only.

A candidate is a run of at least ``min_chars`` characters of the kind that keys are made of, or a value given to a name
like token or password, whatever its length and characters: what stands in quotes, else what has no blank or quote in it.
Both may overlap; a value that is a run counts once, and the other values are numbered after the runs. Its features are its length,
the transitions between kinds of characters, the share that frequent words of the corpus cover (counted over all
documents), the path (the source column and what stands around a path in the text) and the neighbouring words. A random
forest learns from labelled findings; where no labels are given, ``rule_labels`` labels those that are
plain: a quoted value given to a name like token or password is a secret, a run without digits or with only
digits and without such a name is not, and all others stay unlabelled, out of training, and are judged by the forest.

The forest is fitted on a sample of at most about ``train_rows`` labelled findings, chosen by a hash of document and
place; everything else covers all rows. Defined results: null and empty texts have no candidates; rows that repeat
give their findings again; with labels of one class only, every finding gets that class; without labels nothing
is a secret (probability 0); a null path is an empty one; other columns are never read.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradesift.llm.common import read_table, saved

MIN_CHARS = 16
DICTIONARY_WORDS = 200
TRAIN_ROWS = 20_000
TREES = 20
DEPTH = 6
#: Characters before and after a candidate that its neighbouring words are read from.
BEFORE, AFTER = 64, 32

_RUN = r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{%d,}+={0,2}"
_NAMES = r"(?i)(token|secret|passw|pwd|api.?key|access.?key|auth|bearer|private|credential)"
_GIVEN_TO = _NAMES + r"[A-Za-z0-9_.\-]*[\"'`]?\s*[=:]+>?\s*[\"'`]?"
_GIVEN = _GIVEN_TO + "$"
#: Looked at, not taken: a name within a value has a value as well.
_VALUE = _GIVEN_TO + r"(?=((?<=\")[^\"\r\n]+(?=\")|(?<=')[^'\r\n]+(?=')|(?<=`)[^`\r\n]+(?=`)|(?![=:>])[^\s\"'`]+(?<![,;)\]}]))((?s:.{0,%d})))"
_EXAMPLE = r"(?i)(test|example|sample|fixture|mock|doc)"


def frequent_words(docs: DataFrame, n: int, text_col: str = "text") -> list[str]:
    """The most frequent words of three letters or more, over all documents; ties go by the word."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text_col)), r"[^\p{L}]+")).alias("word")).where(F.length("word") >= 3)
    top = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(n)
    return [row.word for row in top.collect()]


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once for each row, however often ``use`` reads it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _found(pattern: str, least: int, candidate: int, after: int, own: bool) -> Column:
    """(candidate, before, after) of every match, from the groups of the pattern. least: characters of the shortest match;
    own: whether the match itself belongs to what stands before."""
    # a match and what stands before it; so many of them hold the last characters before a place
    n = -(-BEFORE // least)
    every = lambda group: F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    read = F.struct(F.split("text", pattern).alias("pieces"), every(0).alias("matches"), every(candidate).alias("candidates"), every(after).alias("afters"))
    heads = lambda r: F.zip_with(r.pieces, r.matches, lambda p, m: F.right(F.concat(p, m), F.lit(BEFORE)))

    def before(r: Column, k: Column) -> Column:
        count = k + 1 if own else k
        last = F.array_join(F.slice(r.heads, F.greatest(count - n, F.lit(0)) + 1, F.least(count, F.lit(n))), "")
        return F.right(last if own else F.concat(last, F.get(r.pieces, k)), F.lit(BEFORE))

    def rows(r: Column) -> Column:
        return F.transform(r.candidates, lambda c, k: F.struct(c.alias("candidate"), before(r, k).alias("before"), F.get(r.afters, k).alias("after")))

    return _bound(read, lambda r: _bound(F.struct(r.pieces.alias("pieces"), r.candidates.alias("candidates"), r.afters.alias("afters"), heads(r).alias("heads")), rows))


def candidates(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """(doc_id, path, finding, candidate, before, after): every candidate with its surroundings, numbered in each text."""
    run, value = f"({_RUN % min_chars})(?=((?s:.{{0,{AFTER}}})))", _VALUE % AFTER
    path = F.lit("") if path_col is None else F.coalesce(F.col(path_col).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), path.alias("path"))
    whole_run = r"^[A-Za-z0-9+/_\-]{%d,}={0,2}\z" % min_chars
    # the shortest name has three characters, and one stands between it and its value
    values = F.filter(_found(value, 4, 2, 3, True), lambda v: ~v.candidate.rlike(whole_run))
    found = narrow.where(F.col("text").rlike(run) | F.col("text").rlike(value)).select(
        "doc_id", "path", F.posexplode(F.concat(_found(run, min_chars, 1, 2, False), values)).alias("finding", "at")
    )
    return found.select("doc_id", "path", "finding", "at.candidate", "at.before", "at.after")


def features(dictionary: list[str]) -> dict[str, Column]:
    """Features of the columns candidate, before, after and path."""
    text = F.col("candidate")
    length = F.length(text).cast("double")
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double") / length
    flag = lambda condition: F.coalesce(condition.cast("double"), F.lit(0.0))
    lower = F.lower(text)
    rest = F.regexp_replace(lower, "|".join(sorted(dictionary, key=lambda w: (-len(w), w))), "") if dictionary else lower
    before = F.col("before")
    last_words = F.regexp_extract(before, r"(\S+\s+)?\S*\s*$", 0)
    return {
        "length": length,
        "digits": share("[0-9]"),
        "capitals": share("[A-Z]"),
        "symbols": share("[^A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split(text, ""))).cast("double") / length,
        "hex": flag(text.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "letter_to_digit": share("(?<=[A-Za-z])[0-9]"),
        "digit_to_letter": share("(?<=[0-9])[A-Za-z]"),
        "case_changes": share("(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]"),
        "vowel_to_consonant": share("(?<=[aeiouAEIOU])[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z]"),
        "consonant_to_consonant": share("(?<=[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z])[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z]"),
        "digit_to_digit": share("(?<=[0-9])[0-9]"),
        "repeats": share(r"(.)(?=\1)"),
        "dictionary": (length - F.length(rest)) / length,
        "slashes": share("/"),
        "in_path": flag(before.rlike(r"(://\S*|[A-Za-z0-9]/|\.)$") | F.col("after").rlike(r"^(/|\.[A-Za-z])")),
        "example_path": flag(F.col("path").rlike(_EXAMPLE)),
        "named": flag(last_words.rlike(_NAMES) | before.rlike(_GIVEN)),
        "given": flag(before.rlike(r"[=:]\s*[\"'`]?$")),
        "quoted": flag(before.rlike(r"[\"'`]$") & F.col("after").rlike(r"^[\"'`]")),
        "words_after": flag(F.col("after").rlike(r"^[\"'`]?\s+\p{L}")),
        "example_words": flag(last_words.rlike(_EXAMPLE)),
    }


def rule_labels() -> Column:
    """1 or 0 where the surroundings leave no doubt, else null."""
    text, before = F.col("candidate"), F.col("before")
    named = before.rlike(_GIVEN)
    quoted = before.rlike(r"[\"'`]$") & F.col("after").rlike(r"^[\"'`]")
    plain = ~text.rlike("[0-9]") | text.rlike("^[0-9]+$")
    return F.when(named & quoted & ~plain, 1.0).when(~named & plain, 0.0)


def judge(found: DataFrame, labels: Column, dictionary: list[str], train_rows: int = TRAIN_ROWS, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """The findings with their probability of being a secret. ``labels``: 1, 0 or null for rows out of training."""
    made = features(dictionary)
    names = list(made)
    ready = saved(found.select("doc_id", "finding", "candidate", labels.cast("double").alias("label"), *[c.alias(f"f_{n}") for n, c in made.items()]))
    sizes = {r.label: r.n for r in ready.where("label in (0.0, 1.0)").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    shown = ["doc_id", "finding", "candidate"]
    if len(sizes) < 2:
        return ready.select(*shown, F.lit(next(iter(sizes), 0.0)).alias("probability"))
    # both classes take half of the sample, where there are that many
    draw = F.pmod(F.xxhash64("doc_id", "finding", "candidate"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("label") == 1, train_rows / 2 / sizes[1.0]).otherwise(train_rows / 2 / sizes[0.0])
    vectors = VectorAssembler(inputCols=[f"f_{n}" for n in names], outputCol="features")
    sample = vectors.transform(ready.where(F.col("label").isin(0.0, 1.0) & (draw < share)).orderBy(*shown).limit(2 * train_rows))
    sample = sample.select("label", "features")
    if sample.select("label").distinct().count() < 2:
        raise ValueError("the sample has one class only; raise train_rows")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=5).fit(sample)
    judged = forest.transform(vectors.transform(ready))
    return judged.select(*shown, vector_to_array("probability")[1].alias("probability"))


def scan(docs: DataFrame, labels: Column | None = None, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text",
         path_col: str | None = None) -> DataFrame:
    """(doc_id, finding, candidate, probability, is_secret) of every candidate."""
    dictionary = frequent_words(docs, DICTIONARY_WORDS, text_col)
    found = candidates(docs, min_chars, id_col, text_col, path_col)
    judged = judge(found, rule_labels() if labels is None else labels, dictionary)
    return judged.withColumn("is_secret", F.col("probability") >= 0.5)


def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = scan(read_table(spark, folder, "documents"), path_col="source")
    return found.select(
        "doc_id", "finding", F.length("candidate").cast("long").alias("n_chars"),
        F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_sha256"), F.round("probability", 6).alias("probability"), "is_secret",
    )
