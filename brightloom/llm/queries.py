"""The operators as queries over whole tables, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exact_dedup, filter_audit, jaccard, langid, quality, secret_scan, sharding, time_tree, toxicity, url_filter, warc
from .common import discard, prepare, shared_folder

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
SHARDS = 8
#: The least score of a url without a rule that is blocked.
SURE = 0.95


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"))
    model = langid.learn(documents.where(~out))
    return langid.predict(documents, model).select("doc_id", out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(_table(spark, sf_dir, "documents"), tokenizer_path())


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = sharding.layout(SHARDS)
    found = sharding.shard_documents(_table(spark, sf_dir, "documents"), tree, sharding.grown(tree, SHARDS))
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls that no rule covers are blocked only if the trees are almost sure, as they learned from other hosts."""
    return url_filter.judge(_table(spark, sf_dir, "pages"), RULES, limit=SURE)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus arrives in two scans of one ledger: half of the documents, then all; the second scans only blobs that are new."""
    documents = _table(spark, sf_dir, "documents")
    ledger = shared_folder(spark, "ledger")
    discard(secret_scan.record(documents.where(F.xxhash64("doc_id") % 2 == 0), ledger))
    return secret_scan.scan(documents, ledger).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, out = _table(spark, sf_dir, "documents"), langid.held_out(F.col("doc_id"))
    model = toxicity.learn(documents, _table(spark, sf_dir, "labels").where(~out))
    return toxicity.toxicity(documents, model).select("doc_id", out.alias("held_out"), "score", "predicted")


def op13_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return time_tree.point_in_time(*(_table(spark, sf_dir, t) for t in ("clicks", "sales", "sale_lines")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_exact_dedup, op2_decontaminate, op3_warc, op4_jaccard_join, op5_language_id, op6_quality, op7_bpe, op8_shard, op9_url_filter, op10_secret_scan, op11_filter_audit, op12_toxicity, op13_point_in_time)
}


def _descend_sql(node: sharding.Node) -> str:
    """The shard of key k below a node: at each level the child with the smallest draw."""
    if not node.children:
        return str(node.shard)
    out, *rest = [(f"-ln((('0x' || substr(md5(k || '/{c.name}'), 1, 12))::bigint + 1)::double / {2**48 + 1}.0) / {c.weight}", _descend_sql(c)) for c in node.children]
    if not rest:
        return out[1]
    draws = [d for d, _ in (out, *rest)]
    cases = " ".join(f"when {d} = least({', '.join(draws)}) then {below}" for d, below in (out, *rest))
    return f"(case {cases} end)"


_TREE = sharding.layout(SHARDS)


def _crc_sql(table: str, text: str) -> str:
    """Common tables: `cells` of the checksum, and `table` with crc for each distinct text of a query with one column k."""
    return f"""cells as (select list(v order by b) as cells from (select b, list_reduce(list_prepend(b::bigint, range(0, 8)), lambda v, i: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end) as v from (select unnest(range(0, 256)) as b))),
        {table} as (select k, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(k)), '..'), lambda x: ('0x' || x)::bigint)), lambda v, b: xor(v >> 8, cells[(xor(v, b) & 255) + 1])), 4294967295) as crc from ({text}), cells)"""


def _secret_sql(kind: int, name: str, pattern: str, keep: str) -> str:
    """Spans of a kind as [start, kind, end, name]; a match starts after the texts between matches and the matches before it."""
    return f"""{name}_m as (select doc_id, regexp_extract_all(t, '{pattern}') as m, list_transform(regexp_split_to_array(t, '{pattern}'), lambda x: length(x)) as gaps from texts),
        {name} as (select doc_id, list_filter(list_transform(range(1, len(m) + 1), lambda i: {{'a': list_sum(gaps[:i]) + coalesce(list_sum(list_transform(m[: i - 1], lambda y: length(y))), 0), 'k': {kind}, 'z': m[i]}}), lambda x: {keep}) as s from {name}_m)"""


_WORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c + "?" for c in w) for w in ("password", "passwd", "secret", "token", "api_key"))
_ASSIGN = f"({_WORDS})[\"\'\']?\\x20*[:=]\\x20*[\"\'\']?([A-Za-z0-9+/_.=-]+)"

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": r"""
        with a as (select doc_id, length(coalesce(text, '')) as chars,
                          sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as sha
                   from documents)
        select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by sha) as group_size,
               row_number() over w = 1 as kept, sha as text_sha256
        from a window w as (partition by sha order by chars desc, doc_id)""",
    "op4_jaccard_join": r"""
        with recursive
        words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
        sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
                        else list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) end as s from words),
        shingles as (select doc_id, unnest(s) as t from sets),
        shared as (select a.doc_id as a, b.doc_id as b, count(*) as n from shingles a join shingles b on a.t = b.t and a.doc_id < b.doc_id group by all),
        links as (select a, b from shared join sets x on x.doc_id = a join sets y on y.doc_id = b where 100 * n >= 90 * (len(x.s) + len(y.s) - n)),
        both_ways as (select a, b from links union all select b, a from links),
        reach as (select doc_id as node, doc_id as seen from sets union select r.node, l.b from reach r join both_ways l on l.a = r.seen)
        select sets.doc_id, len(s)::bigint as n_shingles, min(seen) as component_id from sets join reach on node = sets.doc_id group by sets.doc_id, s""",
    "op3_warc": """
        with p as (select page_id, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as x from pages),
        d as (select *, min(page_id) over (partition by n, x) as first,
                     list_transform(range(0, 8), lambda i: ('0x' || substr(x, 5 * i + 1, 5))::bigint) as parts from p)
        select page_id, n::bigint as payload_bytes,
               array_to_string(list_transform(parts, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((v >> s) & 31) + 1)::bigint, 1)), '')), '') as payload_digest,
               case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to from d""",
    "op11_filter_audit": r"""
        with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
        m as (select doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(min(doc_id) over (partition by t) < doc_id, false)] as fails from d),
        l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as bad from labels group by doc_id),
        c as (select part, fails, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(bad, 0)) as bad from m left join l using (doc_id) group by part, fails),
        f as (select unnest(range(1, 6)) as i),
        o as (select [a.i, b.i, c.i, d.i, e.i] as places from f a, f b, f c, f d, f e where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
        s as (select part, places, step, places[step] as own, fails[places[step]] as fail, list_bool_or(list_transform(places[: step - 1], lambda p: fails[p])) as gone, len(list_filter(fails, lambda x: x)) as bits, n, good, bad from c, o, (select unnest(range(1, 6)) as step)),
        r as (select part, own, sum(n) filter (where fail and not coalesce(gone, false)) as shapley from s group by part, own)
        select s.part, array_to_string(list_transform(places, lambda p: substr('ABCDE', p, 1)), '') as filter_order, step::int as step,
               coalesce(sum(n) filter (where not fail and not coalesce(gone, false)), 0)::bigint as kept, coalesce(sum(n) filter (where fail and not coalesce(gone, false)), 0)::bigint as removed,
               coalesce(sum(n) filter (where fail and gone), 0)::bigint as redundant, coalesce(sum(n) filter (where fail and bits = 1), 0)::bigint as unique_fails,
               coalesce(sum(good) filter (where fail and not coalesce(gone, false)), 0)::bigint as good_lost, coalesce(sum(bad) filter (where fail and not coalesce(gone, false)), 0)::bigint as toxic_lost, coalesce(any_value(shapley), 0)::bigint as shapley
        from s left join r on s.part = r.part and s.own = r.own group by s.part, places, step""",
    "op13_point_in_time": f"""
        with {_crc_sql("hashes", "select distinct coalesce(sale_id::varchar, '') as k from sales")},
        s as (select row_number() over () as r, *, epoch_us(sold_at) as moment, epoch_us(arrived_at) + 14400000000 as known, coalesce(floor(100 * total + 0.5), 0)::bigint as paid from sales where client_id is not null and sold_at is not null),
        probes as (select s.r, sale_id, client_id, d, d * 86400000000 as span, moment + crc % 259200 * 1000000 as t_us from s join hashes on k = coalesce(sale_id::varchar, ''), (values (2), (14)) as w(d)),
        c as (select client_id, click_id, kind, epoch_us(ts) as moment, epoch_us(arrived_at) + 14400000000 as known, coalesce(floor(100 * value + 0.5), 0)::bigint as paid from (select distinct * from clicks)),
        pc as (select r, d, count(*) as n_clicks, count(*) filter (where kind = 'purchase') as n_purchases, sum(paid) as click_cents, first(click_id order by moment desc, click_id desc nulls last) as last_click_id
               from probes p join c using (client_id) where moment > t_us - span and moment <= t_us and known <= t_us group by all),
        ps as (select p.r, d, t_us, s.sale_id, s.paid from probes p join s using (client_id) where moment > t_us - span and moment <= t_us and known <= t_us),
        pt as (select r, d, count(*) as n_sales, sum(paid) as sale_cents from ps group by all),
        pl as (select r, d, count(*) as n_lines, count(distinct item_id) as n_items, sum(coalesce(floor(100 * amount + 0.5), 0)::bigint) as line_cents from ps join sale_lines l using (sale_id) where epoch_us(shipped_at) <= t_us group by all),
        later as (select distinct p.r from probes p join s using (client_id) where moment > t_us and moment <= t_us + 604800000000)
        select sale_id, d::int as d, t_us::bigint as t_us, later.r is not null as label, coalesce(n_clicks, 0)::bigint as n_clicks, coalesce(n_purchases, 0)::bigint as n_purchases, coalesce(click_cents, 0)::bigint as click_cents, last_click_id,
               coalesce(n_sales, 0)::bigint as n_sales, coalesce(sale_cents, 0)::bigint as sale_cents, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_items, 0)::bigint as n_items, coalesce(line_cents, 0)::bigint as line_cents
        from probes p left join pc using (r, d) left join pt using (r, d) left join pl using (r, d) left join later on later.r = p.r""",
    "op8_shard": f"""
        with cells as (select list(v order by b) as cells from (select b, list_reduce(list_prepend(b::bigint, range(0, 8)), lambda v, i: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end) as v from (select unnest(range(0, 256)) as b))),
        t as (select doc_id, coalesce(doc_id::varchar, 'null') as k, strlen(coalesce(text, '')) + 1 as size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::bigint) as bytes from documents),
        c as (select doc_id, k, size, xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda v, b: xor(v >> 8, cells[(xor(v, b) & 255) + 1])), 4294967295) as text_crc32 from t, cells),
        s as (select *, {_descend_sql(_TREE)} as shard, {_descend_sql(sharding.grown(_TREE, SHARDS))} as grown_shard from c)
        select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'key' as law, shard::int as shard, row_number() over (partition by shard order by doc_id, text_crc32, size) - 1 as slot, grown_shard::int as grown_shard from s""",
}

#: SQL for the columns that SQL can express of queries whose other columns it can't.
PARTIAL_SQL: dict[str, str] = {
    "op9_url_filter": f"""
        with p as (select page_id, position('://' in coalesce(url, '')) as mark, coalesce(url, '') as url from pages),
        r as (select page_id, case when mark > 0 then substr(url, mark + 3) else '' end as rest from p),
        h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r),
        rules as (select rule, split_part(rule, '/', 1) as rule_host, substr(rule, position('/' in rule)) as rule_path from (select unnest({[r for _, r in RULES]}) as rule))
        select page_id, host, path, (select arg_max(rule, length(rule)) from rules where (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)) as rule from h""",
    "op10_secret_scan": f"""
        with texts as (select doc_id, coalesce(text, '') as t from documents),
        {_secret_sql(0, "assign", _ASSIGN, f"length(regexp_extract(x.z, '{_ASSIGN}', 2)) >= 8")},
        {_secret_sql(1, "access", "AKIA[A-Z0-9]+", "length(x.z) >= 16")},
        {_secret_sql(2, "hex", "[0-9a-f]+", "length(x.z) >= 32")}
        select doc_id, len(a.s)::bigint as n_assign, len(b.s)::bigint as n_access, len(c.s)::bigint as n_hex,
               sha256(array_to_string(list_transform(list_sort(list_concat(a.s, b.s, c.s)), lambda x: ['assign', 'access', 'hex'][x.k + 1] || ':' || x.a || ':' || (x.a + length(x.z))), ',')) as base_sha256
        from assign a join access b using (doc_id) join hex c using (doc_id)""",
}
