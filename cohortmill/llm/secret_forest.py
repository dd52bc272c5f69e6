"""Secret scans: a random forest tells credentials among long tokens from names, hashes of nothing and plain words.

Everything here is DataFrame expressions and Spark's own forest. What features need to know about the corpus - how
likely one letter follows another, which three letters dictionary words contain, how often a neighbouring word stood
by a true finding - lies in one row of three arrays of fixed length, which is joined to the candidates.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Characters of a candidate without a name at least, findings that a fit reads at most, occurrences that make a dictionary word.
MIN_LENGTH, MAX_FINDINGS, DICTIONARY_COUNT = 16, 200_000, 5
TREES, DEPTH, SEED = 20, 8, 3
_SIGNS, _WORD_BUCKETS, _PATH_BUCKETS, _PRIOR = 28, 4_096, 32, 5.0
_BLANKS = r"[\x20\x09-\x0D]+"
_VALUE = rf"[A-Za-z0-9+/_\-]{{{MIN_LENGTH},}}"
#: What a credential's name holds, in lower case; the short ones only as words.
CREDENTIAL = "passw|pwd|passphrase|secret|token|key|credential|(?<![A-Za-z])(?:pin|pass|auth)(?![A-Za-z])"
_NAME = rf"(?:{CREDENTIAL})[A-Za-z0-9_.\-]{{0,64}}"
_ASSIGNS = r"[\"'`\])}]{0,3}(?::=|=>|={1,3}|:)>?"
#: Ends of an unquoted value: what closes a sentence or a bracket, or the next name with a value in the same word.
_ENDS = r"(?=[.,;:\"'`)\]}>]*(?:[&;,|?][\"']?[A-Za-z_][A-Za-z0-9_.\-]{0,64}[\"']?[=:]|$))"
_OPENED = r"[(\[{<]{0,3}(?:\"(\S*?)(?<!\\)(?:\"|$)|'(\S*?)(?<!\\)(?:'|$)|`(\S*?)(?:`|$)|([^\s\"'`]\S*?)" + _ENDS + ")"
#: A name and its value in one word: group 1 what stands before the value, groups 2 to 5 the value by its quotes.
_ASSIGNED = rf"((?i:{_NAME}){_ASSIGNS}){_OPENED}"
#: A value that is a word of its own behind its name: groups 1 to 4.
_BEHIND = rf"^(?::=|=>|={{1,3}}|:)?{_OPENED}"
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
FEATURES = ["length", "digit_share", "upper_share", "sign_share", "changes", "distinct_share", "transition", "coverage", "assigned",
            "path_bucket", "path_depth", "key_rate", "before_rate", "after_rate"]


def find_candidates(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str = "source") -> DataFrame:
    """(key, path, word_no, value, lead, key_word, before, after): values assigned to a credential's name, and long runs.

    A value assigned to a name of CREDENTIAL by `=`, `:`, `:=` or `=>`, in one word or
    over one or two blanks, is a candidate at any length and with any non-blank signs, without its quotes and the
    brackets and stops around it. Elsewhere, every run of MIN_LENGTH token characters is one. lead: the word's part before
    the value; key_word: the name that the value is assigned to, in the word itself or before a lone `=` or `:`; before,
    after: the neighbouring words. Null texts have no candidates.
    """
    ends_name = rf"(?i:{_NAME}){_ASSIGNS}$"

    def near(words: Column) -> Column:
        def wanted(i: Column) -> Column:
            word, before = F.get(words, i), F.coalesce(F.get(words, i - 1), F.lit(""))
            marked = F.contains(word, F.lit("=")) | F.contains(word, F.lit(":"))
            behind = F.endswith(before, F.lit("=")) | F.endswith(before, F.lit(":")) | F.endswith(before, F.lit("=>"))
            return (F.length(word) >= MIN_LENGTH) | marked | behind

        places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), wanted)
        return F.transform(places, lambda i: F.struct(i.alias("word_no"), F.get(words, i).alias("word"), F.get(words, i - 1).alias("before"),
                                                      F.get(words, i - 2).alias("before_2"), F.get(words, i + 1).alias("after")))

    # The words are an argument of a lambda, so that a text is split once.
    split = F.flatten(F.transform(F.array(F.split(text, _BLANKS)), near))
    found = docs.select(F.col(key).alias("key"), F.col(path).cast("string").alias("path"), F.explode(split).alias("w")).select("key", "path", "w.*")
    lone = F.col("before").isin("=", ":", "=>", ":=")
    begins, named_before = F.col("word").rlike("^(?::=|=>|={1,3}|:)[^=:]"), F.col("before").rlike(rf"(?i:{_NAME})[\"'`\])}}]{{0,3}}$")
    behind = (F.when(lone & F.col("before_2").rlike(rf"(?i:{_NAME})[\"'`\])}}]{{0,3}}$"), F.col("before_2"))
              .when(~lone & F.col("before").rlike(ends_name), F.col("before"))
              .when(begins & named_before, F.col("before")))

    def part(text: Column, pattern: str, groups: range) -> Column:
        return F.concat(*[F.regexp_extract(text, pattern, g) for g in groups])

    inside = F.transform(F.regexp_extract_all("word", F.lit(_ASSIGNED), F.lit(0)), lambda m: F.struct(
        part(m, _ASSIGNED, range(2, 6)).alias("value"),
        F.concat(F.call_function("substring_index", F.col("word"), m, F.lit(1)), F.regexp_extract(m, _ASSIGNED, 1)).alias("lead"), F.lit(None).cast("string").alias("name")))
    whole = part(F.col("word"), _BEHIND, range(1, 5))
    across = F.array(F.struct(whole.alias("value"), F.lit("").alias("lead"), F.col("_behind").alias("name")))
    rest = F.transform(F.regexp_extract_all("_rest", F.lit(_VALUE), F.lit(0)), lambda v: F.struct(
        v.alias("value"), F.call_function("substring_index", F.col("word"), v, F.lit(1)).alias("lead"), F.lit(None).cast("string").alias("name")))
    found = (found.withColumn("_behind", behind).withColumn("_inside", inside)
             .withColumn("_rest", F.when(F.size("_inside") > 0, F.regexp_replace("word", _ASSIGNED, " ")).otherwise(F.col("word")))
             .withColumn("_found", F.when((F.size("_inside") == 0) & F.col("_behind").isNotNull() & (whole != ""), across).otherwise(F.concat("_inside", rest)))
             .select("key", "path", "word_no", "word", "before", "before_2", "after", F.explode("_found").alias("v"))
             .select("*", "v.value", "v.lead", F.col("v.name").alias("_name")).where(F.col("value") != ""))
    lead = F.col("lead")
    name = (F.when(F.col("_name").isNotNull(), F.regexp_extract(F.regexp_replace("_name", r"[^A-Za-z]+$", ""), r"([A-Za-z_\-]+)$", 1))
            .when(lead.rlike("[=:]"), F.regexp_extract(lead, r"([A-Za-z_\-]+)[^A-Za-z]*[=:][^=:]*$", 1)).when(lone, F.col("before_2")))
    return found.select("key", "path", "word_no", "value", lead.alias("lead"), F.lower(F.coalesce(name, F.lit(""))).alias("key_word"),
                        F.lower(F.coalesce("before", F.lit(""))).alias("before"), F.lower(F.coalesce("after", F.lit(""))).alias("after"))


def _sign(c: Column) -> Column:
    """Letters 0 to 25, digits 26, all else 27."""
    return F.when((c >= 97) & (c <= 122), c - 97).when((c >= 48) & (c <= 57), 26).otherwise(27)


def _signs(text: Column) -> Column:
    return F.transform(F.split(F.lower(text), ""), lambda c: _sign(F.ascii(c)))


def _windows(codes: Column, n: int) -> Column:
    """The number of each n signs in a row, to the base of _SIGNS."""
    def at(i: Column) -> Column:
        return sum((F.get(codes, i + k) * _SIGNS ** (n - 1 - k) for k in range(1, n)), F.get(codes, i) * _SIGNS ** (n - 1))

    return F.when(F.size(codes) >= n, F.transform(F.sequence(F.lit(0), F.size(codes) - n), at)).otherwise(F.array().cast("array<int>"))


def corpus_tables(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: `follows` (log share of each pair of signs) and `dictionary` (whether dictionary words hold each triple).

    Counted over the words of 3 to 15 letters of all texts; a dictionary word occurs DICTIONARY_COUNT times. The arrays
    have 784 and 21,952 places, however large the corpus.
    """
    words = docs.select(F.explode(F.split(F.lower(text), _BLANKS)).alias("word"))
    vocabulary = (words.where(F.col("word").rlike("^[a-z]{3,15}[.,;:!?]?$"))
                  .groupBy(F.regexp_replace("word", "[^a-z]", "").alias("word"))
                  .agg(F.count("*").alias("n")))
    settled = cut_lineage(vocabulary.where(F.col("n") >= DICTIONARY_COUNT).withColumn("codes", _signs(F.col("word"))))

    def table(n: int, into: str, value) -> DataFrame:
        counted = settled.select(F.explode(_windows(F.col("codes"), n)).alias("code"), "n").groupBy("code").agg(F.sum("n").alias("n"))
        held = counted.agg(F.map_from_entries(F.collect_list(F.struct("code", "n"))).alias("m"), F.sum("n").alias("total"))
        return held.select(F.transform(F.sequence(F.lit(0), F.lit(_SIGNS**n - 1)), lambda i: value(F.coalesce(F.try_element_at("m", i), F.lit(0)), F.coalesce("total", F.lit(0)))).alias(into))

    follows = table(2, "follows", lambda n, total: F.log((n + 1) / (total + _SIGNS**2)))
    known = table(3, "dictionary", lambda n, total: n > 0)
    return follows.crossJoin(F.broadcast(known))


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(F.regexp_replace(word, "[^a-z]", "")), F.lit(_WORD_BUCKETS)).cast("int")


def neighbour_rates(labelled: DataFrame) -> DataFrame:
    """One row: for each of 4,096 word buckets the smoothed share of true findings that had the word as their name or neighbour."""
    pairs = labelled.select("label", F.explode(F.array(_bucket(F.col("key_word")), _bucket(F.concat(F.lit("b"), F.col("before"))),
                                                       _bucket(F.concat(F.lit("a"), F.col("after"))))).alias("bucket"))
    sums = pairs.groupBy("bucket").agg(F.sum("label").alias("true"), F.count("*").alias("n"))
    held = sums.agg(F.map_from_entries(F.collect_list(F.struct("bucket", F.struct("true", "n").alias("v")))).alias("m"),
                    (F.sum("true") / F.sum("n")).alias("share"))
    share = F.coalesce("share", F.lit(0.0))
    def rate(i: Column) -> Column:
        v = F.try_element_at("m", i)
        return F.coalesce((v["true"] + _PRIOR * share) / (v["n"] + _PRIOR), share)

    return held.select(F.transform(F.sequence(F.lit(0), F.lit(_WORD_BUCKETS - 1)), rate).alias("rates"))


def with_features(candidates: DataFrame, tables: DataFrame, rates: DataFrame) -> DataFrame:
    """The candidates with FEATURES; the one-row tables are sent along (about 300 KB)."""
    value = F.col("value")
    length = F.length(value)

    def share(signs: str) -> Column:
        return (length - F.length(F.translate(value, signs, ""))) / length

    kinds = F.translate(value, _UPPER + _LOWER + _DIGITS + "+/_-", "A" * 26 + "a" * 26 + "9" * 10 + "----")
    joined = candidates.crossJoin(F.broadcast(tables)).crossJoin(F.broadcast(rates)).withColumn("_codes", _signs(value))
    pairs, triples = _windows(F.col("_codes"), 2), _windows(F.col("_codes"), 3)
    mean = F.aggregate(pairs, F.lit(0.0), lambda s, i: s + F.get("follows", i)) / F.greatest(length - 1, F.lit(1))
    covered = F.aggregate(triples, F.lit(0.0), lambda s, i: s + F.get("dictionary", i).cast("double")) / F.greatest(length - 2, F.lit(1))
    return joined.withColumns({
        "length": length.cast("double"), "digit_share": share(_DIGITS), "upper_share": share(_UPPER), "sign_share": F.length(F.regexp_replace(value, "[A-Za-z0-9]+", "")) / length,
        "changes": (F.length(F.regexp_replace(kinds, r"(.)\1*", "x")) - 1).cast("double"),
        "distinct_share": F.size(F.array_distinct(F.split(value, ""))) / length, "transition": mean, "coverage": covered,
        "assigned": (F.col("lead").rlike("[=:]") | (F.col("key_word") != "")).cast("double"),
        "path_bucket": F.pmod(F.xxhash64("path"), F.lit(_PATH_BUCKETS)).cast("double"),
        "path_depth": F.coalesce(F.length("path") - F.length(F.translate("path", "/", "")), F.lit(0)).cast("double"),
        "key_rate": F.get("rates", _bucket(F.col("key_word"))), "before_rate": F.get("rates", _bucket(F.concat(F.lit("b"), F.col("before")))),
        "after_rate": F.get("rates", _bucket(F.concat(F.lit("a"), F.col("after"))))}).drop("follows", "dictionary", "rates", "_codes")


_assembler = dict(inputCols=FEATURES, outputCol="features", handleInvalid="keep")


def fit_forest(findings: DataFrame) -> RandomForestClassificationModel | None:
    """Fit on findings with FEATURES and a 0/1 label, at most MAX_FINDINGS of them by hash; None without findings."""
    known = findings.where(F.col("label").isNotNull())
    n = known.count()
    if not n:
        return None
    if n > MAX_FINDINGS:
        known = known.where(F.pmod(F.xxhash64("key", "word_no", "value"), F.lit(1 << 30)) < int((1 << 30) * MAX_FINDINGS / n))
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return forest.fit(VectorAssembler(**_assembler).transform(known.withColumn("label", F.col("label").cast("double"))))


def scored_findings(candidates: DataFrame, forest: RandomForestClassificationModel | None) -> DataFrame:
    """Candidates with FEATURES, and the forest's share of votes for a true finding as `score` (0 without a forest)."""
    if forest is None:
        return candidates.withColumn("score", F.lit(0.0))
    out = forest.transform(VectorAssembler(**_assembler).transform(candidates))
    votes = vector_to_array("probability")
    return out.withColumn("score", F.coalesce(F.get(votes, F.lit(1)), F.lit(0.0))).drop("features", "rawPrediction", "probability", "prediction")


def scan_secrets(docs: DataFrame, label: Column, teaches: Column, text: str = "text", key: str = "doc_id", path: str = "source") -> DataFrame:
    """All candidates of `docs` with `score`; `label` (over candidate columns) names true findings where `teaches` holds.

    Where `label` is null, a candidate teaches nothing and is only scored.

    Texts are read once for candidates and once for the corpus tables. Null or empty texts, and an empty table, give no
    rows; a null path is a path of its own; repeated rows give repeated findings.
    """
    candidates = cut_lineage(find_candidates(docs, text, key, path))
    tables = cut_lineage(corpus_tables(docs.where(F.col(text).isNotNull()), text))
    taught = candidates.where(teaches).withColumn("label", label.cast("int"))
    rates = cut_lineage(neighbour_rates(taught.where(F.col("label").isNotNull())))
    forest = fit_forest(with_features(taught, tables, rates))
    return scored_findings(with_features(candidates, tables, rates), forest)
