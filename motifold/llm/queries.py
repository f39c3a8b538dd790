"""The registered queries opN_<name>: each operator over its whole table, with the columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifold.llm import bpe, lm_score, mixing, ngram_join, quality_rank, quality_rules, secrets, substring_dedup, topk, toxicity

VOCABULARY = "byte_bpe_50k.json"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(VOCABULARY))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_score.score(_documents(spark, sf_dir), ~lm_score.held_out("doc_id", 7, 2))
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.code(_documents(spark, sf_dir), vocabulary())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2(F.col("text"), 256).alias("decoded_sha256"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    apart = lm_score.held_out("doc_id", 5, 0)
    found = quality_rank.score(docs, quality_rank.fit(docs, labels, "quality", ~apart))
    return found.select("doc_id", apart.alias("held_out"), "score", "predicted")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.expr(secrets.digest("base")), 256).alias("base_sha256"), F.expr(secrets.digest("spans")).alias("spans"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_documents(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    apart = lm_score.held_out("doc_id", 5, 0)
    found = toxicity.score(docs, toxicity.fit(docs, labels, "toxic", ~apart))
    return found.select("doc_id", apart.alias("held_out"), "score", "predicted", "sentences")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove(_documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the longest repeat is known up to the limit only, so it is not shown
    return quality_rules.rate(_documents(spark, sf_dir)).drop("longest_repeat")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(_documents(spark, sf_dir), words=3, percent=90)


def queries() -> dict:
    return {f.__name__: f for f in (op1_lm_score, op2_bpe, op3_quality, op4_secrets, op5_mixing, op6_toxicity, op7_substring_dedup, op8_quality_rules, op9_topk, op10_ngram_join)}


_WORD = r"[^\x20\x09-\x0D]+"

def _secrets_sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"

    def found(pattern: str) -> str:
        """Start, end and text of a pattern's matches, from the pieces between them."""
        p = quote(pattern)
        pieces, matches = f"string_split_regex(text, {p})", f"regexp_extract_all(text, {p})"
        before = f"list_sum(list_transform({pieces}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform({matches}[1:i-1], lambda x: length(x))), 0)"
        return f"list_transform(range(1, len({matches}) + 1), lambda i: {{'s': ({before})::int, 'e': ({before} + length({matches}[i]))::int, 'v': {matches}[i]}})"

    def kept(pattern: str, group: int, least: int) -> str:
        return f"list_filter({found(pattern)}, lambda x: length(regexp_extract(x.v, {quote(pattern)}, {group})) >= {least})"

    base = ", ".join(f"{kept(p, g, n)} as {k}" for k, p, g, n in secrets.PATTERNS)
    alphabet = "case " + " ".join(f"when regexp_matches(v, {quote(p)}) then {quote(a)}" for p, a in secrets.ALPHABETS[:-1]) + f" else {quote(secrets.ALPHABETS[-1][1])} end"
    tail = lambda z: f"(1 / (1 + exp(least(700, greatest(-700, 1.5976 * ({z}) + 0.070566 * ({z}) * ({z}) * ({z}))))))"
    tagged = lambda k, o: f"list_transform({k}, lambda x: {{'s': x.s, 'o': {o}, 'kind': '{k}', 'e': x.e}})"
    join = lambda x: f"array_to_string(list_transform({x}, lambda x: x.kind || ':' || x.s || ':' || x.e), ',')"
    products = "list_transform(range(1, n), lambda i: (d[i] - mean) * (d[i + 1] - mean))"
    return f"""
with t as (select doc_id, coalesce(text, '') as text from documents),
a as (select doc_id, {base}, list_filter({found(secrets.CANDIDATE)}, lambda x: regexp_matches(x.v, '[0-9]') and regexp_matches(x.v, '[A-Za-z]') and length(regexp_replace(x.v, '=+$', '')) >= 20) as drawn from t),
b as (select *, list_sort(list_concat(list_concat({tagged("assign", 0)}, {tagged("access", 1)}), {tagged("hex", 2)})) as base from a),
c as (select doc_id, x.s as s, x.e as e, x.v as v from (select doc_id, base, unnest(drawn) as x from b) where len(list_filter(base, lambda y: y.s < x.e and x.s < y.e)) = 0),
d as (select *, {alphabet} as alphabet, regexp_replace(v, '=+$', '') as run from c),
e as (select *, length(run) as n, length(alphabet) as k, list_transform(string_split(run, ''), lambda x: instr(alphabet, x)::double) as d from d),
f as (select *, list_sum(d) / n as mean, list_sum(list_transform(list_distinct(d), lambda y: pow(len(list_filter(d, lambda z: z = y)), 2))) as squares, len(list_filter(d, lambda y: y > k / 2.0)) as up,
        1 + coalesce(list_sum(list_transform(range(1, n), lambda i: case when (d[i] > k / 2.0) <> (d[i + 1] > k / 2.0) then 1 else 0 end)), 0) as runs from e),
g as (select *, (pow(greatest(0.0, k * squares / n - n) / (k - 1), 1.0 / 3) - (1 - 2.0 / (9 * (k - 1)))) / sqrt(2.0 / (9 * (k - 1))) as za,
        case when up = 0 or up = n then sqrt(n) else (runs - (2.0 * up * (n - up) / n + 1)) / sqrt(greatest(0.01, 2.0 * up * (n - up) * (2.0 * up * (n - up) - n) / (1.0 * n * n * (n - 1)))) end as zb,
        sqrt(n) * list_sum({products}) / greatest(0.01, list_sum(list_transform(d, lambda y: (y - mean) * (y - mean)))) as zc from f),
h as (select *, -(ln(greatest(1e-300, {tail("za")})) + ln(greatest(1e-300, least(1.0, 2 * {tail("abs(zb)")}))) + ln(greatest(1e-300, least(1.0, 2 * {tail("abs(zc)")})))) as half from g),
i as (select doc_id, s, e, floor(log2(e - s))::int as stratum, least({secrets.BINS}, floor(100 * (half - ln(1 + half + half * half / 2)) / ln(10.0)))::int as bin from h),
j as (select stratum, bin, count(*) as many from i group by all),
l as (select stratum, min(bin) as bin from (select *, sum(many) over (partition by stratum order by bin desc) as k, sum(many) over (partition by stratum) as m from j) where pow(10.0, -bin / 100.0) <= 0.05 * k / m group by stratum),
r as (select doc_id, list({{'s': s, 'o': 3, 'kind': 'random', 'e': e}}) as random from i left join l using (stratum) where l.bin is null or i.bin < l.bin group by doc_id)
select doc_id, len(assign)::bigint as n_assign, len(access)::bigint as n_access, len(hex)::bigint as n_hex, sha256({join("base")}) as base_sha256,
    {join("list_sort(list_concat(base, coalesce(random, [])))")} as spans from b left join r using (doc_id)"""


#: What DuckDB can express; the rest is tested against brute force.
_ORACLES = {
    "op4_secrets": _secrets_sql(),
    "op5_mixing": rf"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::bigint as size, length(coalesce(text, '')) as n,
        length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')) as junk,
        (('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u from documents),
k as (select *, -ln(u) / greatest(0.05, 1 - 5.0 * junk::double / greatest(1, n)) as key from d),
s as (select source, sum(size)::bigint as words, [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight from k group by source),
c as (select *, 2.0 * words::double as cap, 2.0 * words::double / weight as level, 1.5 * sum(words) over ()::double as budget from s),
f as (select *, sum(cap) over (order by level, source) + level * (sum(weight) over () - sum(weight) over (order by level, source)) <= budget as full_ from c),
t as (select *, case when full_ then cap else (budget - sum(case when full_ then cap else 0 end) over ()) / sum(case when full_ then 0 else weight end) over () * weight end as target from f),
e as (select *, case when words > 0 then floor(target / words)::bigint else 0 end as epochs from t),
r as (select k.doc_id, k.size, e.words, e.target, e.epochs, e.target - e.epochs * e.words as rest,
        sum(k.size) over (partition by k.source order by k.key, k.doc_id rows unbounded preceding)::double as run from k join e on k.source is not distinct from e.source)
select doc_id, size, words as source_size, target, size * (epochs + case when run - size / 2.0 <= rest then 1 else 0 end) as taken from r""",
    "op8_quality_rules": rf"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '{_WORD}') as w from d),
p as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from w),
{", ".join(f"h{k} as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, md5(array_to_string(w[i:i+{k - 1}], chr(1)))) as c from p where i + {k - 1} <= len(w)) where c > 1)" for k in (3, 8, 200))},
{", ".join(f"c{k} as (select doc_id, count(distinct j) as n from (select doc_id, unnest(range(i, i + {k})) as j from h{k}) group by doc_id)" for k in (3, 8))},
l as (select doc_id, count(*) - count(distinct x) as n from (select doc_id, unnest(string_split(text, chr(10))) as x from d) where regexp_matches(x, '{_WORD}') group by doc_id),
b as (select w.doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
        coalesce(l.n, 0)::bigint as n_dup_lines, coalesce(c3.n, 0)::bigint as n_repeat_words, coalesce(c8.n, 0)::bigint as covered_words, w.doc_id in (select doc_id from h200) as long_repeat
        from w left join l using (doc_id) left join c3 using (doc_id) left join c8 using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
        not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * covered_words <= 40 * n_words and not long_repeat as kept from b""",
    "op9_topk": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
        where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.vec_id as query_id, x.vec_id, list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2]))::bigint as score from v q join v x on q.vec_id % 20 = 0 and q.vec_id <> x.vec_id)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s qualify rank <= 20""",
    "op10_ngram_join": rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') as w from documents),
g as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, chr(1))] else list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], chr(1)))) end as s from d),
z as (select doc_id, len(s)::bigint as n from g),
t as (select doc_id, unnest(s) as x from g),
o as (select a.doc_id as a, b.doc_id as b, count(*) as n from t a join t b on a.x = b.x and a.doc_id < b.doc_id group by all),
e as (select o.a, o.b from o join z p on p.doc_id = o.a join z q on q.doc_id = o.b where 100 * o.n >= 90 * (p.n + q.n - o.n)),
u as (select a, b from e union all select b, a from e),
r(doc_id, c) as (select doc_id, doc_id from z union select u.b, r.c from r join u on u.a = r.doc_id)
select z.doc_id, z.n as n_shingles, min(r.c) as component_id from z join r using (doc_id) group by all""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
