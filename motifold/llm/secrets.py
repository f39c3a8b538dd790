"""Secret scans by a battery of randomness tests, with SQL functions only.

Base spans are assignments to a secret's name, access keys, and long hexadecimal runs. Beside them, runs of 20 or more key characters
with letters and digits that touch no base span are candidates. From its characters a candidate's encoding is inferred (hexadecimal,
base32, one case with digits, base64), and three tests ask whether it looks like uniform draws from that alphabet: chi-squared over
the alphabet, runs above and below the middle of it, and serial correlation. Fisher's method combines them into one p-value.
Benjamini-Hochberg control, apart for each length (strata by powers of two, since longer runs give the tests more power), rejects those that
are not random; what is not rejected is a secret of kind `random`.

Spans are code points, end exclusive. A null or empty text has no spans. Every row gets one row; the other columns are not read.
Found spans and p-values are written once; the control needs the counts of p-values in bins of 0.01 of their logarithm, a bounded table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from motifold.llm.shared import written

#: The fixed patterns: kind, pattern, group that is measured, its least length.
PATTERNS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Alphabets in the order in which they are tried: the characters a run may have, and the alphabet itself.
ALPHABETS = (
    ("^[0-9a-f]+$", "0123456789abcdef"),
    ("^[0-9A-F]+$", "0123456789ABCDEF"),
    ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("^[a-z0-9]+$", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("^[A-Z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"),
    ("^[A-Za-z0-9_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
BINS = 30_000


def _q(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(text: str, pattern: str) -> str:
    """SQL for the array of (s, e, v) of a pattern's matches, from the pieces between them."""
    p, kind = _q(pattern), "array<struct<s:int,e:int,v:string>>"
    step = "named_struct('s', a.pos + length(x.p), 'e', a.pos + length(x.p) + length(x.m), 'v', x.m)"
    found = (
        f"aggregate(arrays_zip(split({text}, {p}, -1) as p, regexp_extract_all({text}, {p}, 0) as m), named_struct('pos', 0, 'out', cast(array() as {kind})), "
        f"(a, x) -> if(x.m is null, a, named_struct('pos', a.pos + length(x.p) + length(x.m), 'out', concat(a.out, array({step})))), a -> a.out)"
    ).replace(f"arrays_zip(split({text}, {p}, -1) as p, regexp_extract_all({text}, {p}, 0) as m)", f"zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), (p, m) -> named_struct('p', p, 'm', m))")
    return f"if({text} rlike {p}, {found}, cast(array() as {kind}))"


def _base(text: str, kind: str, pattern: str, group: int, least: int) -> str:
    value = f"regexp_extract(x.v, {_q(pattern)}, {group})" if group else "x.v"
    return f"filter({_spans(text, pattern)}, x -> length({value}) >= {least})"


def _upper(z: str) -> str:
    """The normal distribution's upper tail, to about 0.0002."""
    return f"(1 / (1 + exp(least(700, greatest(-700, 1.5976D * ({z}) + 0.070566D * ({z}) * ({z}) * ({z}))))))"


def _battery(v: str) -> str:
    """SQL for -log10 of the combined p-value, in hundredths, of the string v."""
    alphabet = "case " + " ".join(f"when {v} rlike {_q(p)} then {_q(a)}" for p, a in ALPHABETS[:-1]) + f" else {_q(ALPHABETS[-1][1])} end"
    # t: the run without padding, its alphabet's size k, the places of its characters in the alphabet
    start = f"transform(array(named_struct('t', regexp_replace({v}, '=+$', ''), 'b', {alphabet})), w -> named_struct('n', length(w.t), 'k', length(w.b), 'd', transform(filter(split(w.t, ''), c -> c <> ''), c -> cast(instr(w.b, c) as double))))"
    counts = "aggregate(array_distinct(w.d), 0D, (a, c) -> a + pow(size(filter(w.d, y -> y = c)), 2))"
    mean = "(aggregate(w.d, 0D, (a, y) -> a + y) / w.n)"
    one = (
        f"transform({start}, w -> named_struct('n', w.n, 'k', w.k, 'chi', greatest(0D, w.k * {counts} / w.n - w.n), 'up', size(filter(w.d, y -> y > w.k / 2D)), "
        "'runs', 1 + aggregate(zip_with(slice(w.d, 1, w.n - 1), slice(w.d, 2, w.n - 1), (y, z) -> if((y > w.k / 2D) <> (z > w.k / 2D), 1, 0)), 0, (a, y) -> a + y), "
        f"'m', {mean}, 'd', w.d))"
    )
    two = (
        f"transform({one}, w -> named_struct("
        "'za', (pow(w.chi / (w.k - 1), 1D / 3) - (1 - 2D / (9 * (w.k - 1)))) / sqrt(2D / (9 * (w.k - 1))), "
        "'zb', if(w.up = 0 or w.up = w.n, sqrt(w.n), (w.runs - (2D * w.up * (w.n - w.up) / w.n + 1)) / sqrt(greatest(0.01D, 2D * w.up * (w.n - w.up) * (2D * w.up * (w.n - w.up) - w.n) / (1D * w.n * w.n * (w.n - 1))))), "
        "'zc', sqrt(w.n) * aggregate(zip_with(slice(w.d, 1, w.n - 1), slice(w.d, 2, w.n - 1), (y, z) -> (y - w.m) * (z - w.m)), 0D, (a, y) -> a + y) / greatest(0.01D, aggregate(w.d, 0D, (a, y) -> a + (y - w.m) * (y - w.m)))))"
    )
    half = f"transform({two}, w -> -(ln(greatest(1e-300D, {_upper('w.za')})) + ln(greatest(1e-300D, least(1D, 2 * {_upper('abs(w.zb)')}))) + ln(greatest(1e-300D, least(1D, 2 * {_upper('abs(w.zc)')})))))"
    return f"element_at(transform({half}, h -> cast(least({BINS}D, floor(100 * (h - ln(1 + h + h * h / 2)) / ln(10D))) as int)), 1)"


def _found(docs: DataFrame, text_column: str, keep: list[Column]) -> DataFrame:
    """Columns `keep`, base (kind, s, e) and drawn (s, e, bin, stratum) of each row."""
    text = docs.select(*keep, F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("_text"))
    each = text.select("*", *[F.expr(_base("_text", *p)).alias(f"_{p[0]}") for p in PATTERNS], F.expr(f"filter({_spans('_text', CANDIDATE)}, x -> x.v rlike '[0-9]' and x.v rlike '[A-Za-z]' and length(regexp_replace(x.v, '=+$', '')) >= 20)").alias("_drawn"))
    base = "concat(" + ", ".join(f"transform(_{k}, x -> named_struct('s', x.s, 'o', {i}, 'kind', '{k}', 'e', x.e))" for i, (k, *_) in enumerate(PATTERNS)) + ")"
    based = each.select(*[f"`{c}`" for c in text.columns], *[F.expr(f"size(_{k})").cast("long").alias(f"n_{k}") for k, *_ in PATTERNS], F.expr(f"array_sort({base})").alias("_base"), "_drawn")
    apart = based.withColumn("_drawn", F.expr("filter(_drawn, x -> not exists(_base, y -> y.s < x.e and x.s < y.e))"))
    return apart.withColumn("_drawn", F.expr(f"transform(_drawn, x -> named_struct('s', x.s, 'e', x.e, 'bin', {_battery('x.v')}, 'stratum', cast(floor(log2(x.e - x.s)) as int)))"))


def _limits(found: DataFrame, rate: float) -> Column:
    """A map from stratum to the least bin that is rejected; strata are powers of two of a text's length, so they are few."""
    bins = found.select(F.explode("_drawn").alias("d")).groupBy("d.stratum", "d.bin").count()
    down = W.partitionBy("stratum").orderBy(F.desc("bin"))
    ranked = bins.withColumn("k", F.sum("count").over(down)).withColumn("m", F.sum("count").over(W.partitionBy("stratum")))
    passed = ranked.where(F.pow(F.lit(10.0), -F.col("bin") / 100.0) <= rate * F.col("k") / F.col("m")).groupBy("stratum").agg(F.min("bin").alias("bin"))
    rows = passed.collect()
    entries = [x for r in rows for x in (F.lit(r["stratum"]), F.lit(r["bin"]))]
    return F.create_map(*entries) if entries else F.expr("cast(map() as map<int,int>)")


def _with_spans(found: DataFrame, limits: Column) -> DataFrame:
    judged = found.withColumn("_limit", limits)
    drawn = "transform(filter(_drawn, x -> x.bin < coalesce(_limit[x.stratum], 2147483647)), x -> named_struct('s', x.s, 'o', 3, 'kind', 'random', 'e', x.e))"
    return judged.withColumn("_all", F.expr(f"array_sort(concat(_base, {drawn}))"))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rate: float = 0.05) -> DataFrame:
    """id, n_assign, n_access, n_hex, base (array of kind, s, e) and spans (the same with what the battery finds) of each row."""
    found = written(_found(docs, text_column, [F.col(id_column).alias("_id")]).drop("_text"), "spans")
    return _with_spans(found, _limits(found, rate)).select(F.col("_id").alias(id_column), "n_assign", "n_access", "n_hex", F.col("_base").alias("base"), F.col("_all").alias("spans"))


def digest(spans: str) -> str:
    """SQL for kind:start:end of each span, joined by commas."""
    return f"array_join(transform({spans}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')"


def redact(docs: DataFrame, text_column: str = "text", mark: str = "[secret]", rate: float = 0.05) -> DataFrame:
    """docs with each secret in the text replaced by the mark; all other columns and a null text as they are."""
    found = _found(docs, text_column, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")])
    judged = _with_spans(found, _limits(written(found.select("_drawn"), "drawn"), rate))
    whole = (
        f"aggregate(_all, named_struct('pos', 0, 'out', ''), (a, x) -> named_struct('pos', greatest(a.pos, x.e), 'out', "
        f"if(x.s < a.pos, a.out, concat(a.out, substring(_text, a.pos + 1, x.s - a.pos), {_q(mark)}))), a -> concat(a.out, substring(_text, a.pos + 1)))"
    )
    text = F.when(F.col(f"_row.`{text_column}`").isNull() | (F.size("_all") == 0), F.col(f"_row.`{text_column}`")).otherwise(F.expr(whole))
    return judged.select(*[text.alias(c) if c == text_column else F.col(f"_row.`{c}`") for c in docs.columns])
