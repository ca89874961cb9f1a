"""Secret scanning with DataFrame functions only.

Base rules are regular expressions. The method adds tokens that no rule names: for every long token with letters and
digits an encoding is inferred (hexadecimal, base32, base64), and a battery of randomness tests is run against that
alphabet: chi-squared uniformity, runs above and below the middle, serial correlation. The three p-values are combined
(Fisher) and, inside each class of lengths, tokens whose randomness is rejected under a false-discovery rate (Benjamini
and Hochberg) are ordinary text; the others are reported as `random`.

Null texts count as empty. Repeated rows stay separate rows. Offsets are code points, ends exclusive. An empty table gives an empty
result. Columns other than `doc_id` and `text` are not read. Work grows with the text and with its tokens, not with their product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import written

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # maximal runs, so the same spans as runs of any length of which those under 16 are dropped
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
SPAN = "array<struct<start:int,kind:int,end:int,piece:string>>"
#: Matches that are gathered before they join the rest.
CHUNK = 128

HEX_DIGITS = "0123456789abcdef"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

#: Bins of -ln p to a unit, the largest bin, and the false-discovery rate.
BINS, TOP_BIN, RATE = 10, 400, 0.01


def bound(x: Column, use) -> Column:
    """`use` of a value that is worked out once: inside a lambda, an expression would be worked out at every turn."""
    return F.element_at(F.transform(F.array(x), use), 1)


def spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Leftmost non-overlapping matches whose `group` has `least` characters, as structs of start, kind, end and the match.

    Matches are gathered in runs of CHUNK, so that arrays are not copied for each one.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    empty = F.array().cast(SPAN)

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + F.length(x["gap"])
        end = start + F.length(x["whole"])
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["whole"].alias("piece")))
        return F.struct(F.coalesce(end, start).alias("at"), F.when(F.length(x["tested"]) >= least, F.concat(done["out"], span)).otherwise(done["out"]).alias("out"))

    def run(done: Column, chunk: Column) -> Column:
        return bound(F.aggregate(chunk, F.struct(done["at"].alias("at"), empty.alias("out")), step), lambda r: F.struct(r["at"].alias("at"), F.concat(done["out"], r["out"]).alias("out")))

    def gathered(zipped: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(zipped) - 1) / CHUNK).cast("int")), lambda i: F.slice(zipped, i * CHUNK + 1, F.lit(CHUNK)))
        return F.aggregate(chunks, F.struct(F.lit(0).alias("at"), empty.alias("out")), run, lambda x: x["out"])

    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), tested.alias("tested"))
    return F.when(text.rlike(pattern), bound(zipped, gathered)).otherwise(empty)


def normal_upper(z: Column) -> Column:
    """Upper tail of the standard normal distribution, by a logistic form."""
    z = F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    return 1.0 / (1.0 + F.exp(1.5976 * z + 0.07056 * F.pow(z, F.lit(3.0))))


def battery(token: Column) -> Column:
    """Fisher's combined p-value of three randomness tests of a token under the encoding that it seems to have."""
    token = F.when(token.rlike("^[0-9A-F]+$"), F.lower(token)).otherwise(token)
    body = F.translate(F.rtrim(token, F.lit("=")), "-_", "+/")
    alphabet_of = lambda b: F.when(b.rlike("^[0-9a-f]+$"), F.lit(HEX_DIGITS)).when(b.rlike("^[A-Z2-7]+$"), F.lit(BASE32)).otherwise(F.lit(BASE64))

    def tests(x: Column) -> Column:
        n, k = F.size(x["i"]).cast("double"), x["k"].cast("double")
        counts = F.transform(F.sequence(F.lit(0), x["k"] - 1), lambda s: F.size(F.filter(x["i"], lambda i: i == s)).cast("double"))
        chi = F.aggregate(counts, F.lit(0.0), lambda a, c: a + F.pow(c - n / k, F.lit(2.0)) / (n / k))
        df = k - 1.0
        p_chi = normal_upper((F.pow(chi / df, F.lit(1.0 / 3)) - (1.0 - 2.0 / (9.0 * df))) / F.sqrt(2.0 / (9.0 * df)))
        pairs = F.arrays_zip(F.slice(x["i"], F.lit(1), F.size(x["i"]) - 1).alias("a"), F.slice(x["i"], F.lit(2), F.size(x["i"]) - 1).alias("b"))
        high = F.size(F.filter(x["i"], lambda i: i >= x["k"] / 2)).cast("double")
        runs = 1.0 + F.size(F.filter(pairs, lambda p: (p["a"] >= x["k"] / 2) != (p["b"] >= x["k"] / 2)))
        product = 2.0 * high * (n - high)
        spread = F.sqrt(F.greatest(product * (product - n) / (n * n * (n - 1.0)), F.lit(1e-9)))
        p_runs = F.when(product <= n, F.lit(1e-9)).otherwise(F.least(2.0 * normal_upper(F.abs(runs - product / n - 1.0) / spread), F.lit(1.0)))
        mean = (k - 1.0) / 2.0
        square = F.aggregate(x["i"], F.lit(0.0), lambda a, i: a + F.pow(i - mean, F.lit(2.0)))
        cross = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + (p["a"] - mean) * (p["b"] - mean))
        p_serial = F.least(2.0 * normal_upper(F.abs(cross / F.greatest(square, F.lit(1e-9))) * F.sqrt(n)), F.lit(1.0))
        half = -(F.ln(F.greatest(p_chi, F.lit(1e-12))) + F.ln(F.greatest(p_runs, F.lit(1e-12))) + F.ln(F.greatest(p_serial, F.lit(1e-12))))
        return F.exp(-half) * (1.0 + half + half * half / 2.0)

    # each step is bound, so that none is worked out again for every character
    indexed = lambda x: F.struct(F.transform(F.split(x["body"], ""), lambda c: F.instr(x["alphabet"], c) - 1).alias("i"), F.length(x["alphabet"]).alias("k"))
    return bound(bound(bound(body, lambda b: F.struct(b.alias("body"), alphabet_of(b).alias("alphabet"))), indexed), tests)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, and the spans as an array (`found`) for masking."""
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = lambda found: F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    base = docs.select(F.col("doc_id").cast("long"), text.alias("text")).select(
        "doc_id",
        F.array_sort(F.concat(*[plain(spans(F.col("text"), *how)) for how in ((ASSIGN, 0, 2, 12), (ACCESS, 1, 0, 18), (HEX, 2, 0, 16))])).alias("base"),
        F.filter(spans(F.col("text"), TOKEN, 3, 0, 20), lambda s: s["piece"].rlike("[0-9]") & s["piece"].rlike("[A-Za-z]")).alias("tokens"),
    )
    clear = lambda x, s: ~F.exists(x["base"], lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"]))
    bin_ = lambda piece: F.least(F.floor(-F.ln(F.greatest(battery(piece), F.lit(1e-30))) * BINS), F.lit(TOP_BIN)).cast("int")
    one = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.floor(F.log2((s["end"] - s["start"]).cast("double"))).cast("int").alias("size"), bin_(s["piece"]).alias("bin"))
    # base spans and tokens are bound together: no lambda below works them out again, and none looks at the text
    tested = bound(F.struct("base", "tokens"), lambda x: F.struct(x["base"].alias("base"), F.transform(F.filter(x["tokens"], lambda s: clear(x, s)), one).alias("tested")))
    base = base.select("doc_id", tested.alias("both")).select("doc_id", "both.base", F.col("both.tested").alias("tested"))
    found = written(base, "secret-spans")
    limits = rejection_bins(found)
    is_text = lambda t: F.coalesce(F.element_at(limits, t["size"]), F.lit(TOP_BIN + 1)) <= t["bin"]
    added = F.transform(F.filter("tested", lambda t: ~is_text(t)), lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    joined = lambda spans_: F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    every = F.array_sort(F.concat("base", added))
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(every).alias("spans"), every.alias("found"),
    )


def rejection_bins(found: DataFrame) -> Column:
    """Map from a class of lengths to the least bin of -ln p at which randomness is rejected (Benjamini and Hochberg).

    What reaches the driver has a row for each class of lengths, of which there are at most 31.
    """
    bins = found.select(F.explode("tested").alias("t")).groupBy(F.col("t.size").alias("size"), F.col("t.bin").alias("bin")).agg(F.count("*").alias("n"))
    within = Window.partitionBy("size")  # at most TOP_BIN + 1 rows a class
    ranked = bins.select("size", "bin", F.sum("n").over(within).alias("m"), F.sum("n").over(within.orderBy(F.desc("bin"))).alias("rejected"))
    rows = ranked.where(F.col("m") * F.exp(-F.col("bin") / BINS) / F.col("rejected") <= RATE).groupBy("size").agg(F.min("bin").alias("bin")).collect()
    pairs = [F.lit(int(x)) for r in rows for x in (r["size"], r["bin"])]
    return F.create_map(*pairs) if pairs else F.create_map(F.lit(-1), F.lit(0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("found")
