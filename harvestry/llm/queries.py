"""The registered queries of this subpackage and their DuckDB SQL.

Each query applies one operator, with production parameters, to the whole of its
table. ``SQL`` has an entry where DuckDB can say the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestry.llm import (exact_dedup, license_scan, line_dedup, mixing, packing, prefix_trie, quality, simhash,
                           substring_dedup, token_align, token_count, url_filter, warc)
from harvestry.llm.common import LOWER, UPPER, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def registered(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


# -- 1: URL filters -----------------------------------------------------------------------------

#: The rules of the contract (action, host, path prefix).
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def _url_sql() -> str:
    fits = [(r[1] + r[2], r[0], f"(host = '{r[1]}' or ends_with(host, '.{r[1]}')) and starts_with(path, '{r[2]}')")
            for r in sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))]
    case = lambda i: "case " + " ".join(f"when {f[2]} then '{f[i]}'" for f in fits) + " end"
    def hits(terms):
        return " + ".join(f"regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::int" for t in terms)
    strict = [t for t, w in url_filter.VOCABULARY.items() if w >= url_filter.THRESHOLD]
    soft = [t for t, w in url_filter.VOCABULARY.items() if w < url_filter.THRESHOLD]
    upper, lower = UPPER, LOWER
    return f"""
with p as (
  select page_id, translate(coalesce(url, ''), '{upper}', '{lower}') as low,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), '{upper}', '{lower}') as host,
         regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) as path from pages
), h as (select *, ({hits(strict)})::int as n_strict, ({hits(soft)})::int as n_soft from p)
select page_id, host, path, {case(0)} as rule,
       coalesce({case(1)}, case when n_strict * {url_filter.THRESHOLD} + n_soft >= {url_filter.THRESHOLD} then 'block' else 'allow' end) as verdict,
       n_strict, n_soft
from h"""


@registered("op1_url_filters", _url_sql())
def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


# -- 2: exact deduplication ---------------------------------------------------------------------

@registered("op2_exact_dedup", r"""
with d as (
  select doc_id, length(coalesce(text, '')) as n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as text_sha256 from documents
)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size,
       row_number() over w = 1 as kept, text_sha256
from d window w as (partition by text_sha256 order by n desc, doc_id)""")
def exact_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


# -- 6: quality rules ---------------------------------------------------------------------------

def _quality_sql() -> str:
    b, rules = quality.KEPT_BITS, quality.RULES
    at = lambda p: f"q{p}" if p else "0"
    def limit(k, sign, rule):
        if rule is None:
            return "cast(null as bigint)"
        centre, allowance, (times, upper, lower) = rule
        return f"max(case when measure = '{k}' then {at(centre)} {sign} ({allowance} + {times} * ({at(upper)} - {at(lower or 0)})) end)"
    limit_cols = ", ".join(f"{limit(k, '+', above)} as high_{k}, {limit(k, '-', below)} as low_{k}" for k, (above, below) in rules.items())
    quantiles = ", ".join(f"min(bin) filter (below * 100 >= al * {p}) as q{p}" for p in quality.QUANTILES)
    def limits(name, keys):
        by = "".join(k + ", " for k in keys)
        group = ", ".join(keys)
        return f"""
{name}_bins as (select {by}measure, bin, sum(n) as n from bins group by {by}measure, bin),
{name}_run as (select {by}measure, bin, sum(n) over (partition by {by}measure order by bin) as below,
                      sum(n) over (partition by {by}measure) as al from {name}_bins),
{name}_q as (select {by}measure, max(al) as docs, {quantiles} from {name}_run group by {by}measure),
{name}_lim as (select {by}max(docs) as docs, {limit_cols} from {name}_q {'group by ' + group if keys else ''})"""
    sides = [f"{s}_{k}" for k in rules for s in ("low", "high")]
    def shrunk(own, docs, wider):
        return f"coalesce(floor(({own} * {docs} + {wider} * {quality.PRIOR}) / ({docs} + {quality.PRIOR}))::bigint, {wider})"
    pick = ", ".join(f"{shrunk('o.' + x, 'o.docs', shrunk('l.' + x, 'l.docs', 'a.' + x))} as {x}" for x in sides)
    inside = " and ".join(f"not coalesce({k} {'>' if s == 'high' else '<'} {s}_{k}, false)" for k in rules for s in ("low", "high"))
    return rf"""
with t as (select doc_id, lang, source, coalesce(text, '') as text from documents),
w as (select *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from t),
win as (select doc_id, u.i as i, array_to_string(words[u.i:u.i + 4], ' ') as seq
        from w, unnest(range(1, len(words) - 3)) as u(i) where len(words) >= 5),
again as (select doc_id, i from (select *, count(*) over (partition by doc_id, seq) as c from win) where c > 1),
cov as (select doc_id, count(distinct i + k) as n_repeat_words from again, unnest(range(0, 5)) as v(k) group by doc_id),
s as (select w.doc_id, lang, source, len(words) as n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) as n_symbols,
             len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
             len(lines) as n_lines from w left join cov on w.doc_id = cov.doc_id),
m as (select *, case when n_words > 0 then n_symbols * 1000 // n_words end as symbols,
             case when n_words > 0 then word_chars * 100 // n_words end as word_length,
             case when n_lines > 0 then n_dup_lines * 1000 // n_lines end as dup_lines,
             case when n_words > 0 then n_repeat_words * 1000 // n_words end as repeats from s),
long as ({" union all ".join(f"select lang, source, '{k}' as measure, {k} as v from m where {k} is not null" for k in rules)}),
bins as (select lang, source, measure, (v >> greatest(length(bin(v)) - {b}, 0)) << greatest(length(bin(v)) - {b}, 0) as bin, count(*) as n
         from long group by all),
{limits('own', ['lang', 'source'])},{limits('lang', ['lang'])},{limits('every', [])},
lim as (select o.lang, o.source, {pick} from own_lim o left join lang_lim l on o.lang is not distinct from l.lang cross join every_lim a),
v as (select m.*, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, {inside} as inside
      from m left join lim on m.lang is not distinct from lim.lang and m.source is not distinct from lim.source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed, not base_failed and inside as kept from v"""


@registered("op6_quality_rules", _quality_sql())
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf_dir, "documents"))


# -- 10: mixing ---------------------------------------------------------------------------------

def _mixing_sql() -> str:
    w = ", ".join(str(float(x)) for x in mixing.WEIGHTS)
    cap = mixing.MAX_REPEATS
    rounds, once, joins = _mixing_rounds(mixing.ROUNDS)
    return rf"""
with d as (select doc_id, source, substr(md5(coalesce(doc_id::varchar, '')), 1, 15) as h,
                  len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [{w}][(row_number() over (order by source is null, source) - 1) % {len(mixing.WEIGHTS)} + 1]::double as weight,
             (source_size * {cap})::double as cap from s),
r as (select *, sum(source_size) over ()::double as total,
             coalesce(sum(cap) over (order by cap / weight, source is null, source rows between unbounded preceding and 1 preceding), 0) as capped,
             sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, source is null, source rows between unbounded preceding and 1 preceding), 0) as rest from w),
l as (select *, (total - capped) / rest as here from r),
t as (select *, max(case when here * weight <= cap then here end) over () as level from l),
g as (select source, source_size, least(coalesce(level * weight, cap), cap) as target from t),
b as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as repeats from g),
k as (select *, target - repeats * source_size as budget from b),
{rounds}
select doc_id, size, k.source_size, k.target, (least({cap}, k.repeats + ({once})::int) * size)::bigint as taken
from d join k on d.source is not distinct from k.source{joins}"""


def _mixing_rounds(rounds: int) -> tuple[str, str, str]:
    """CTEs k0.. (edge: the hash at which the round's budget ends; left: what is left of it), the test of a document, the joins."""
    ctes, tests, joins = [], [], []
    for r in range(rounds):
        before = "k" if r == 0 else f"k{r - 1}"
        budget = "k.budget" if r == 0 else f"k{r - 1}.gap"
        may = "true" if r == 0 else f"k{r - 1}.edge is not null and d.h >= k{r - 1}.edge and d.size <= k{r - 1}.gap"
        ctes.append(f"""
c{r} as (select d.source, d.h, sum(d.size) as words, max({budget}) as budget
         from d join {before} on d.source is not distinct from {before}.source where {may} group by d.source, d.h),
u{r} as (select *, sum(words) over (partition by source order by h) as upto from c{r}),
k{r} as (select source, min(h) filter (upto > budget) as edge, min_by(words, h) filter (upto > budget) as edge_words,
                min_by(budget - (upto - words), h) filter (upto > budget) as gap, max(budget) as had from u{r} group by source)""")
        nearer = f" or (d.h = k{r}.edge and k{r}.edge_words <= 2 * k{r}.gap)" if r == rounds - 1 else ""
        # a source without a row in k{r} has nothing that the round may take
        tests.append(f"(coalesce({may}, false) and k{r}.had is not null and (k{r}.edge is null or d.h < k{r}.edge{nearer}))")
        joins.append(f"\nleft join k{r} on d.source is not distinct from k{r}.source")
    return ",".join(ctes), " or ".join(tests), "".join(joins)


@registered("op10_mixing", _mixing_sql())
def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


# -- 5: SimHash near-duplicates -----------------------------------------------------------------

@registered("op5_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                         F.col("component").alias("component_id"))


# -- 8: token counts ----------------------------------------------------------------------------

#: Fixed value: the tokenizer's <|endoftext|>, which no text encodes to.
END_OF_DOCUMENT = 49407


@registered("op8_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and the flat file and place in it at which the scan found the document."""
    flat = token_count.write_flat(table(spark, sf_dir, "documents"), END_OF_DOCUMENT)
    counts = token_count.count_tokens(flat.filter("block is not null").select("file", "block", "tokens"), END_OF_DOCUMENT)
    names = flat.filter("nth is not null").select("file", "nth", F.col("id").alias("doc_id"))
    return names.join(counts, ["file", "nth"], "left").select("doc_id", "n_tokens", "file", "nth")


# -- 9: packing ---------------------------------------------------------------------------------

@registered("op9_packing")
def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.pack(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


# -- 3: license scans ---------------------------------------------------------------------------

@registered("op3_license_scans")
def license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).select("doc_id", "license", "dice", "n_matches")


# -- 4: line deduplication ----------------------------------------------------------------------

@registered("op4_line_dedup", r"""
with l as (select doc_id, u.i as i, string_split(coalesce(text, ''), chr(10))[u.i] as line
           from documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as u(i)),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
c as (select key, count(distinct doc_id) as n, min(doc_id) as least from k where length(key) >= 10 group by key),
d as (select k.*, coalesce(n > 1 and doc_id <> least, false) as dropped from k left join c on k.key = c.key)
select doc_id, count(*) as n_lines, count(*) filter (dropped) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (not dropped), '')) as kept_sha256
from d group by doc_id""")
def line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents arrive in two batches, so the second goes through the first one's filters."""
    docs = table(spark, sf_dir, "documents")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    index = line_dedup.LineIndex().insert(docs.filter(half == 0)).insert(docs.filter(half == 1))
    kept = line_dedup.drop_repeated_lines(docs, index)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


# -- 7: substring deduplication -----------------------------------------------------------------

@registered("op7_substring_dedup")
def substring_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.remove_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


# -- 13: cross-tokenizer alignment --------------------------------------------------------------

@registered("op13_token_alignment")
def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.link_counts(table(spark, sf_dir, "documents"))


# -- 11: WARC -----------------------------------------------------------------------------------

@registered("op11_warc", f"""
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select *, min(page_id) over (partition by payload_digest) as first_id from p)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes < {warc.MIN_REVISIT} or page_id = first_id then 'response' else 'revisit' end as record_type,
       case when payload_bytes >= {warc.MIN_REVISIT} and page_id <> first_id then first_id end as refers_to
from f""")
def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


# -- 12: conversation prefix trie ---------------------------------------------------------------

@registered("op12_prefix_trie", """
with recursive t as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, sha256(coalesce(role, '') || chr(0) || coalesce(text, ''))) as i,
                  coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
k as (select c, c - c % 5 as b, xor(list_reduce([4294967295::bigint] || list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint),
        lambda crc, byte: list_reduce([xor(crc, byte)] || list_transform(range(8), lambda z: 0::bigint), lambda r, z: case when r & 1 = 1 then xor(r >> 1, 3988292384) else r >> 1 end)),
        4294967295) % 9 as h from (select distinct c from t)),
r as (select k.c, t.i, 0 as own, t.role, t.text from k join t on t.c = k.b and t.i <= k.h
      union all select k.c, t.i, 1, t.role, t.text from k join t on t.c = k.c and t.i > k.h),
n as (select c, row_number() over (partition by c order by own, i) as d, sha256(role || chr(0) || text) as e, strlen(text) as bytes from r),
p as (select k.c, 0::bigint as d, '' as key, null::varchar as up, 0::bigint as bytes from k
      union all select n.c, n.d, sha256(p.key || n.e), p.key, n.bytes from p join n on n.c = p.c and n.d = p.d + 1),
m as (select d, key, any_value(up) as up, any_value(bytes) as bytes, min(c) as conv_id, count(*) as n_convs from p group by d, key),
ends as (select d, key, string_agg(c::varchar, ',' order by c) as ids from (select *, max(d) over (partition by c) as last from p) where d = last group by d, key),
kids as (select d - 1 as d, up as key, count(*) as n_children from m where d > 0 group by all),
lines as (select distinct o.d, o.key, u.d as ud, u.key as ukey from p o join p u on u.c = o.c and u.d >= o.d),
subtree as (select l.d, l.key, count(*) filter (kids.key is null) as n_leaves, sum((m.n_convs - 1) * m.bytes)::bigint as saved_tokens
            from lines l join m on m.d = l.ud and m.key = l.ukey left join kids on kids.d = l.ud and kids.key = l.ukey group by l.d, l.key)
select m.conv_id, m.d as depth, a.conv_id as parent_conv_id, m.n_convs, coalesce(kids.n_children, 0) as n_children, n_leaves, saved_tokens,
       sha256(coalesce(ids, '')) as ends_sha256
from m join subtree s on s.d = m.d and s.key = m.key left join m a on a.d = m.d - 1 and a.key = m.up
     left join kids on kids.d = m.d and kids.key = m.key left join ends on ends.d = m.d and ends.key = m.key""")
def prefix_trie_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
