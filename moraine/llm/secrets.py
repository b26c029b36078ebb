"""Secret scan: base patterns, and random-looking tokens found by a battery of randomness tests; native expressions only.

A candidate is a run of key characters of at least 20 with letters and digits. Its encoding is inferred
from its characters (hexadecimal, base32, base62, base64). Against the encoding's alphabet three tests
ask whether it may be random: chi-squared uniformity of the characters, runs above and below the middle of
the alphabet, and serial correlation of neighbouring characters. Their probabilities under randomness, combined with a Bonferroni
correction over the tests and over the stretches of a long candidate, go through Benjamini-Hochberg control over all
candidates of all documents: only as many random ones are given up as the rate allows, however long they are.
The other way about, a candidate has, by length, a probability that text would show its chi-squared value: for wide alphabets by the
number of coinciding character pairs, which in words is far above that of random characters; for hexadecimal by the share
of letters that words would put outside a-f. These probabilities are corrected and controlled alike, so short tokens need stronger evidence. A candidate
whose randomness is not rejected and whose being text is rejected is a secret.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from moraine.llm import common

#: Patterns, in the order of kinds; all are applied leftmost and without overlaps.
#: The look-ahead only spares the alternatives at most positions.
ASSIGN = r"""(?i)(?=[pPsStTaA])(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: AKIA and as many letters and digits as follow, 20 characters at least: the same matches as of AKIA[A-Z0-9]+ of that length.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex")

HEX_DIGITS = "0123456789abcdef"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
BASE64 = BASE62 + "+/"
#: Chance that two characters of words coincide, and that a letter of words is one of a-f.
TEXT_COINCIDENCE = 0.066
TEXT_A_TO_F = 0.30
#: Longest stretch that the statistics of one candidate take in; longer candidates are cut to stretches of nearly equal length, which are judged together.
STRETCH = 512
BINS_PER_DECADE = 20
MOST_DECADES = 20


def _lengths(parts: Column) -> Column:
    return F.transform(parts, lambda p: F.length(p))


def _with_spans(df: DataFrame, i: str, block: int = 256) -> DataFrame:
    """Adds ``s<i>``: start and end of each match in ``m<i>``, by summing up the lengths of matches and of what ``p<i>`` has between them.

    Sums go in two levels, each a column of its own, so that many matches cost their number times the block at most.
    """
    between = F.zip_with(_lengths(F.slice(F.col(f"p{i}"), F.lit(1), F.size(f"m{i}"))), _lengths(F.col(f"m{i}")), lambda a, b: F.array(a, b))
    df = df.withColumn(f"l{i}", F.flatten(between))
    df = df.withColumn(f"b{i}", F.expr(f"transform(sequence(0, int((greatest(size(l{i}), 1) - 1) / {block})), k -> slice(l{i}, k * {block} + 1, {block}))"))
    # Columns stand outside of lambdas here: the optimizer may put their expressions in their place.
    offsets = f"aggregate(b{i}, array(0), (o, x) -> concat(o, array(element_at(o, -1) + aggregate(x, 0, (n, y) -> n + y))))"
    inside = "transform(x, (y, j) -> o + aggregate(slice(x, 1, j + 1), 0, (n, z) -> n + z))"
    df = df.withColumn(f"s{i}", F.expr(f"flatten(zip_with(b{i}, slice({offsets}, 1, size(b{i})), (x, o) -> {inside}))"))
    return df.drop(f"l{i}", f"b{i}", f"p{i}")


def _normal_tail(z: Column) -> Column:
    """Upper tail of the normal distribution (a rational approximation with an error below 1e-7, relative for z > 0)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-a * a / 2) / 2.5066282746310002 * series
    return F.when(z >= 0, upper).otherwise(1 - upper)


def _p_values(candidates: DataFrame) -> DataFrame:
    """Adds p_random and p_text to rows with ``token``; each step is a projection of its own, so nothing is computed twice."""
    df = candidates.withColumn("hexadecimal", F.col("token").rlike("^([0-9a-f]+|[0-9A-F]+)$"))
    df = df.withColumn("body", F.when(F.col("hexadecimal"), F.lower("token")).otherwise(F.translate(F.regexp_replace("token", "=+$", ""), "-_=", "+//")))
    alphabet = F.when(F.col("hexadecimal"), F.lit(HEX_DIGITS)).when(F.col("body").rlike("^[A-Z2-7]+$"), F.lit(BASE32)).when(F.col("body").rlike("[+/]"), F.lit(BASE64)).otherwise(F.lit(BASE62))
    df = df.withColumn("alphabet", alphabet)
    df = df.withColumn("k", F.length("alphabet").cast("double")).withColumn("n", F.length("body").cast("double"))
    df = df.withColumn("codes", F.expr("transform(filter(split(body, ''), c -> c <> ''), c -> cast(locate(c, alphabet) - 1 as double))"))
    df = df.withColumn("counts", F.expr("transform(filter(split(alphabet, ''), c -> c <> ''), c -> cast(length(body) - length(replace(body, c, '')) as double))"))
    df = df.withColumn("squares", F.expr("aggregate(counts, 0D, (a, c) -> a + c * c)"))
    # Chi-squared, by the cube root transformation.
    cube = F.expr("cbrt((k / n * squares - n) / (k - 1))")
    df = df.withColumn("p_chi", _normal_tail((cube - (1 - 2 / (9 * (F.col("k") - 1)))) / F.sqrt(2 / (9 * (F.col("k") - 1)))))
    # Runs above and below the middle of the alphabet.
    df = df.withColumn("high", F.expr("size(filter(codes, c -> c >= k / 2))").cast("double")).withColumn("low", F.col("n") - F.col("high"))
    df = df.withColumn("runs", F.expr("1D + size(filter(sequence(1, size(codes) - 1), i -> (codes[i] >= k / 2) <> (codes[i - 1] >= k / 2)))"))
    df = df.withColumn("mean_runs", 1 + 2 * F.col("high") * F.col("low") / F.col("n"))
    spread = F.sqrt(F.greatest((F.col("mean_runs") - 1) * (F.col("mean_runs") - 2) / (F.col("n") - 1), F.lit(1e-9)))
    df = df.withColumn("p_runs", F.when((F.col("high") < 2) | (F.col("low") < 2), F.lit(0.0)).otherwise(2 * _normal_tail(F.abs(F.col("runs") - F.col("mean_runs")) / spread)))
    # Serial correlation of neighbours.
    df = df.withColumn("mean", F.expr("aggregate(codes, 0D, (a, c) -> a + c) / n"))
    df = df.withColumn("variance", F.expr("aggregate(codes, 0D, (a, c) -> a + (c - mean) * (c - mean))"))
    df = df.withColumn("lagged", F.expr("aggregate(sequence(1, size(codes) - 1), 0D, (a, i) -> a + (codes[i] - mean) * (codes[i - 1] - mean))"))
    z = (F.col("lagged") / F.greatest(F.col("variance"), F.lit(1e-9)) + 1 / F.col("n")) * F.sqrt("n")
    df = df.withColumn("p_serial", 2 * _normal_tail(F.abs(z)))
    df = df.withColumn("p_random", F.least(F.lit(1.0), 3 * F.least("p_chi", "p_runs", "p_serial")))
    # Text: pairs of equal characters against what words have; letters within a-f.
    df = df.withColumn("pairs", F.col("n") * (F.col("n") - 1) / 2)
    expected = F.col("pairs") * TEXT_COINCIDENCE
    wide = _normal_tail((expected - (F.col("squares") - F.col("n")) / 2) / F.sqrt(expected))
    letters = F.expr("length(regexp_replace(body, '[0-9]', ''))")
    df = df.withColumn("p_text", F.when(F.col("hexadecimal"), F.pow(F.lit(TEXT_A_TO_F), letters)).otherwise(wide))
    return df.select(*candidates.columns, "p_random", "p_text")


def rejected_from(counts: dict[int, int], rate: float) -> int:
    """Benjamini-Hochberg over binned probabilities: the lowest bin that is rejected (above all bins if none is)."""
    tested, so_far, least = sum(counts.values()), 0, MOST_DECADES * BINS_PER_DECADE + 1
    for place, n in sorted(counts.items(), reverse=True):
        so_far += n
        if 10.0 ** (-place / BINS_PER_DECADE) <= rate * so_far / tested:
            least = place
    return least


def scan(
    documents: DataFrame,
    alpha: float = 0.01,
    rate: float = 0.001,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, key, base, added) of every document: arrays of (start, kind number, end) spans in code points, sorted; key hashes id and text.

    Null texts count as empty and have no spans. ``base`` has the pattern matches; ``added`` the candidates not half of which a base span covers, whose randomness
    is not rejected at the rate ``alpha`` and whose being text is rejected at ``rate``. Repeated rows each give a row, and all of their candidates count in the control. Further columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = documents.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.monotonically_increasing_id().alias("row"))
    patterns = {"m0": ASSIGN, "m1": ACCESS, "m2": HEX, "m3": CANDIDATE}
    df = df.select("*", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(m) for m, p in patterns.items()])
    none = F.array().cast("array<string>")
    df = df.select("*", *[F.when(F.size(m) > 0, F.split("text", p, -1)).otherwise(none).alias(f"p{m[1]}") for m, p in patterns.items()]).drop("text")
    for m in patterns:
        df = _with_spans(df, m[1])

    empty = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")

    def spans(i: int, keep=lambda m: F.lit(True)) -> Column:
        """Structs of the matches of one kind that are kept; starts and ends alternate in ``s<i>``."""
        pairs = F.zip_with(F.col(f"m{i}"), F.expr(f"transform(sequence(0, size(m{i}) - 1), k -> slice(s{i}, 2 * k + 1, 2))"), lambda m, s: F.when(keep(m), F.struct(s[0].alias("start"), F.lit(i).alias("kind"), s[1].alias("end"))))
        return F.when(F.size(f"m{i}") > 0, F.filter(pairs, lambda x: x.isNotNull())).otherwise(empty)

    base = F.array_sort(F.concat(spans(0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_LEAST), spans(1), spans(2)))
    mixed = "m3[i] rlike '[0-9]' and m3[i] rlike '[A-Za-z]'"
    tokens = F.when(F.size("m3") > 0, F.expr(f"filter(transform(sequence(0, size(m3) - 1), i -> IF({mixed}, struct(s3[2 * i] AS start, s3[2 * i + 1] AS end, m3[i] AS token), null)), x -> x is not null)"))
    df = df.select("row", "key", "doc_id", base.alias("base"), tokens.alias("tokens"))
    # A candidate half of which a base span covers adds nothing.
    apart = F.expr("filter(tokens, t -> not exists(base, b -> 2 * (least(b.end, t.end) - greatest(b.start, t.start)) >= t.end - t.start))")
    df = common.materialize(df.select("row", "key", "doc_id", "base", apart.alias("tokens")))

    judged = df.filter(F.size("tokens") > 0).select("row", F.explode("tokens").alias("t"))
    pieces = f"int((length(t.token) - 1) / {STRETCH}) + 1"
    cut = f"explode(transform(sequence(1, {pieces}), i -> substring(t.token, int((i - 1) * length(t.token) / ({pieces})) + 1, int(i * length(t.token) / ({pieces})) - int((i - 1) * length(t.token) / ({pieces})))))"
    judged = judged.select("row", F.col("t.start").alias("start"), F.col("t.end").alias("end"), F.expr(cut).alias("token"))
    judged = _p_values(judged).groupBy("row", "start", "end")
    # The least of several probabilities, times their number.
    judged = judged.agg((F.min("p_random") * F.count("*")).alias("p_random"), (F.min("p_text") * F.count("*")).alias("p_text"))
    place = lambda p: F.least(F.floor(-F.log10(F.least(F.greatest(p, F.lit(1e-300)), F.lit(1.0))) * BINS_PER_DECADE), F.lit(MOST_DECADES * BINS_PER_DECADE)).cast("int")
    judged = common.materialize(judged.withColumn("odd", place(F.col("p_random"))).withColumn("bin", place(F.col("p_text"))))
    which = F.explode(F.array(F.struct(F.lit(0).alias("test"), F.col("odd").alias("bin")), F.struct(F.lit(1).alias("test"), F.col("bin").alias("bin"))))
    counts = judged.select(which.alias("w")).groupBy("w.test", "w.bin").agg(F.count("*").alias("n")).collect()  # 802 rows at most
    odd, least_bin = (rejected_from({row["bin"]: row["n"] for row in counts if row["test"] == test}, level) for test, level in ((0, alpha), (1, rate)))
    chosen = judged.filter((F.col("odd") < odd) & (F.col("bin") >= least_bin))
    chosen = chosen.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", F.lit(3).alias("kind"), "end"))).alias("added"))
    return df.join(common.materialize(chosen), "row", "left").select("doc_id", "key", "base", F.coalesce("added", empty).alias("added"))


def redact(documents: DataFrame, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with every found span replaced by ``mark``, all columns and rows kept, and n_chars, if there, counted anew.

    Spans that overlap or touch are replaced together. Null and empty texts stay as they are; repeated rows are each redacted; rows that share an id may differ in text: the join is on id
    and a hash of both. An empty table stays empty.
    """
    spans = scan(documents, id_col=id_col, text_col=text_col)
    found = spans.select("doc_id", "key", F.concat("base", "added").alias("spans")).filter(F.size("spans") > 0)
    found = found.groupBy("key", "doc_id").agg(F.first("spans").alias("spans")).select("key", "doc_id", F.explode("spans").alias("s")).select("key", "doc_id", "s.start", "s.end")
    # Runs of spans that touch: one begins where all before have ended.
    own = Window.partitionBy("key", "doc_id").orderBy("start")
    ended = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("begins", F.when(ended >= F.col("start"), 0).otherwise(1)).withColumn("run", F.sum("begins").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    found = found.groupBy("key", "doc_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    found = found.groupBy("key", "doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))
    id_, key, runs, changed = common.unused(documents.columns, "id", "key", "runs", "redacted")
    found = common.materialize(found.select(F.col("doc_id").alias(id_), F.col("key").alias(key), F.col("runs").alias(runs)))
    rows = documents.join(found.hint("merge"), (F.xxhash64(F.col(id_col), F.col(text_col)) == F.col(key)) & F.col(id_col).eqNullSafe(F.col(id_)), "left")
    # What stands before each run, and after the last.
    pieces = F.expr(f"transform(sequence(0, size(`{runs}`)), i -> substring(`{text_col}`, IF(i = 0, 0, `{runs}`[i - 1].end) + 1, IF(i = size(`{runs}`), length(`{text_col}`), `{runs}`[i].start) - IF(i = 0, 0, `{runs}`[i - 1].end)))")
    rows = rows.withColumn(changed, F.when(F.size(runs) > 0, F.array_join(pieces, mark)).otherwise(F.col(text_col)))
    columns = []
    for c in documents.columns:
        column = F.col(changed).alias(c) if c == text_col else F.coalesce(F.length(changed).cast(documents.schema[c].dataType), F.col(c)).alias(c) if c == "n_chars" else F.col(c)
        columns.append(column)
    return rows.select(*columns)


#: Names of the kinds by number; the last are spans that the battery adds.
NAMES = (*KINDS, "random")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans sorted by start, then kind, comma-joined."""
    names = F.array(*[F.lit(n) for n in NAMES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, SHA-256 of the base spans, and all spans."""

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )
