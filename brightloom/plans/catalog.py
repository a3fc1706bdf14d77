"""The library's queries over the driver's tables, each with the SQL that gives the same rows.

Orders stand for posts, customers for their authors, events for tokens and for daily series, labelled documents and
line items for training rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.functions import scalar
from brightloom.operators import cart, learning, metrics, paging, ranking, retrieval, series, snapshot, validation
from brightloom.session import checkpointed, shared_folder
from brightloom.sources import layout
from brightloom.sources.tables import table
from brightloom.streaming import tokens, windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

AS_OF = "2024-01-15 00:00:00"
KEY = b"a key for tests only"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def orders(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders")


def customers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer")



def newest() -> list:
    return [F.desc("o_orderdate"), F.desc("o_orderkey")]


# ---- Pages ---------------------------------------------------------------------------------------

PAGE = "o_orderkey, o_custkey, o_orderdate, o_totalprice, c_name"


def _paged(rows: DataFrame, s: SparkSession, d: str, skip: int, limit: int) -> DataFrame:
    some = paging.page(rows.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"), newest(), skip, limit)
    return paging.with_related(some, customers(s, d).select("c_custkey", "c_name"), "o_custkey", "c_custkey").select(*PAGE.split(", "))


@query(f"select {PAGE} from (select * from orders order by o_orderdate desc, o_orderkey desc limit 10 offset 20) left join customer on c_custkey = o_custkey")
def page_all(s, d):
    return _paged(orders(s, d), s, d, 20, 10)


@query(f"select {PAGE} from (select * from orders where o_custkey = 7 order by o_orderdate desc, o_orderkey desc limit 10) left join customer on c_custkey = o_custkey")
def page_by_author(s, d):
    return _paged(orders(s, d).where("o_custkey = 7"), s, d, 0, 10)


@query("select count(*) as total, 20 as skip, 10 as \"limit\", cast(greatest(0, least(10, count(*) - 20)) as bigint) as returned, 20 + greatest(0, least(10, count(*) - 20)) < count(*) as has_more from orders")
def page_envelope(s, d):
    return paging.envelope(orders(s, d), 20, 10)


@query("""with p as (select * from orders order by o_orderdate desc, o_orderkey desc limit 10 offset 20), n as (select count(*) as total from orders)
    select to_json(list({'id': o_orderkey, 'title': o_orderstatus, 'date_posted': strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), 'user_id': o_custkey, 'author': case when c_custkey is not null then {'id': c_custkey, 'username': c_name} end} order by o_orderdate desc, o_orderkey desc))::varchar as posts,
           any_value(total) as total, 20 as skip, 10 as "limit", 20 + count(*) < any_value(total) as has_more from p left join customer on c_custkey = o_custkey, n""")
def page_response(s, d):
    """The nested page with its authors, as the text of the response's array."""
    item = [F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("date_posted"), F.col("o_custkey").alias("user_id")]
    author = [F.col("c_custkey").alias("id"), F.col("c_name").alias("username")]
    rows = orders(s, d).select("o_orderkey", "o_orderstatus", "o_orderdate", "o_custkey")
    got = paging.response(rows, newest(), customers(s, d).select("c_custkey", "c_name"), "o_custkey", "c_custkey", item, author, 20, 10)
    return got.withColumn("posts", F.to_json("posts", {"ignoreNullFields": "false"}))


@query("with r as (select o_orderkey, row_number() over (order by o_orderdate desc, o_orderkey desc) - 1 as n from orders) select cast(n // 10 as int) as page, o_orderkey from r where n < 50")
def page_sequence(s, d):
    parts = [paging.page(orders(s, d).select("o_orderkey", "o_orderdate"), newest(), 10 * i, 10).select(F.lit(i).alias("page"), "o_orderkey") for i in range(5)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("select o_orderkey, o_orderdate from orders where (o_orderdate, o_orderkey) < (timestamp '1998-01-01', 100) order by o_orderdate desc, o_orderkey desc limit 10")
def page_keyset(s, d):
    stamp = F.lit("1998-01-01").cast("timestamp_ntz")
    return paging.keyset_page(orders(s, d).select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", (stamp, 100), 10)


@query("select * from region order by r_regionkey limit 5")
def preview(s, d):
    return table(s, d, "region").orderBy("r_regionkey").limit(5)


# ---- Projections and scalars ---------------------------------------------------------------------


def _features(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("l_quantity").alias("x1"), F.col("l_extendedprice").alias("x2"), F.col("l_returnflag").alias("y"))


@query("select l_quantity as x1, l_extendedprice as x2, l_returnflag as y from lineitem")
def scan_project(s, d):
    return _features(table(s, d, "lineitem"))


@query("select * exclude (c_acctbal) from customer")
def drop_column(s, d):
    return customers(s, d).drop("c_acctbal")


@query("select c_custkey as id, c_name as username, case when c_mktsegment is not null then c_mktsegment end as segment from customer")
def public_projection(s, d):
    return customers(s, d).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.col("c_mktsegment").alias("segment"))


@query("select doc_id, lang from documents where lang is not null")
def not_null_project(s, d):
    return table(s, d, "documents").where("lang is not null").select("doc_id", "lang")


@query("""select c_custkey, case when f is not null and f <> '' then '/media/profile_pics/' || f else '/static/profile_pics/default.jpg' end as image_path
    from (select c_custkey, case c_custkey % 3 when 0 then null when 1 then '' else c_name || '.jpg' end as f from customer)""")
def case_projection(s, d):
    f = F.when(F.col("c_custkey") % 3 == 0, F.lit(None)).when(F.col("c_custkey") % 3 == 1, "").otherwise(F.concat("c_name", F.lit(".jpg")))
    return customers(s, d).select("c_custkey", scalar.image_path(f).alias("image_path"))


def _strings(rows: DataFrame) -> DataFrame:
    p = F.col("o_orderpriority")
    return rows.select(
        "o_orderkey", scalar.long_date(F.col("o_orderdate")).alias("day"), F.substring(p, 1, 5).alias("prefix"), F.concat("o_orderstatus", F.lit("'s order")).alias("title"), scalar.shortened(p, 6).alias("short"),
        scalar.truncated(F.col("o_totalprice") / 1000, 3).alias("truncated"), scalar.html_escaped(F.concat(F.lit("<a&"), p, F.lit(">"))).alias("escaped"), scalar.id_or_null(F.substring(p, 1, 1)).alias("number"), scalar.id_or_null(p).alias("no_number"),
    )


@query("""select o_orderkey, strftime(o_orderdate, '%B %d, %Y') as day, substr(o_orderpriority, 1, 5) as prefix, o_orderstatus || '''s order' as title,
    case when length(o_orderpriority) > 6 then substr(o_orderpriority, 1, 6) || '...' else o_orderpriority end as short,
    trunc(o_totalprice / 1000 * 1000) / 1000 as truncated, replace(replace(replace('<a&' || o_orderpriority || '>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as escaped,
    try_cast(substr(o_orderpriority, 1, 1) as int) as number, try_cast(o_orderpriority as int) as no_number from orders""")
def string_fns(s, d):
    return _strings(orders(s, d))


@query("""select r_name, case when lower(m) in ('release', 'prod', 'production') then false else try_cast(lower(m) as boolean) end as debug, ((5 * 1024 * 1024 + r_regionkey) // (1024 * 1024))::bigint as mb, sha256(r_name) as digest
    from (select *, ['PROD', 'true', 'Release', 'no', 'x'][r_regionkey + 1] as m from region)""")
def settings_fns(s, d):
    m = F.element_at(F.array(*map(F.lit, ("PROD", "true", "Release", "no", "x"))), F.col("r_regionkey") + 1)
    return table(s, d, "region").select("r_name", scalar.debug_flag(m).alias("debug"), F.expr("(5 * 1024 * 1024 + r_regionkey) div (1024 * 1024)").alias("mb"), scalar.token_hash(F.col("r_name")).alias("digest"))


def _blob(data: bytes) -> str:
    return "'" + "".join(f"\\x{b:02x}" for b in data) + "'::blob"


def _url64(blob: str) -> str:
    return f"rtrim(translate(to_base64({blob}), '+/', '-_'), '=')"


_PAD = KEY.ljust(64, b"\0")
_INNER, _OUTER = (_blob(bytes(b ^ x for b in _PAD)) for x in (0x36, 0x5C))
_SIGNED = f"""{_url64('encode(\'{"alg":"HS256","typ":"JWT"}\')')} || '.' || {_url64("encode('{\"sub\":\"' || c_custkey || '\",\"exp\":' || (1800000000 + c_custkey) || '}')")}"""


@query(f"""with t as (select c_custkey, {_SIGNED} as signed from customer)
    select c_custkey, signed || '.' || {_url64(f"unhex(sha256({_OUTER} || unhex(sha256({_INNER} || encode(signed)))))")} as token,
    case when 1800000000 + c_custkey > 1800000100 then c_custkey::varchar end as subject, cast(null as varchar) as forged from t""")
def jwt_round_trip(s, d):
    rows = customers(s, d).select("c_custkey", scalar.jwt(F.col("c_custkey"), F.lit(1_800_000_000) + F.col("c_custkey"), KEY).alias("token"))
    now = F.lit(1_800_000_100)
    return rows.select("c_custkey", "token", scalar.jwt_subject(F.col("token"), KEY, now).alias("subject"), scalar.jwt_subject(F.col("token"), b"another", now).alias("forged"))


@query("select event_id, json_extract_string(props, '$.k') as k from events")
def json_envelope(s, d):
    parsed = F.from_json("props", "k string")
    return table(s, d, "events").select("event_id", parsed["k"].alias("k"))


@query("select c_custkey, to_json({'id': c_custkey, 'username': c_name, 'segment': c_mktsegment})::varchar as body from customer")
def json_response(s, d):
    """The public columns as a response's text; null fields are written."""
    of = F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.col("c_mktsegment").alias("segment"))
    return customers(s, d).select("c_custkey", F.to_json(of, {"ignoreNullFields": "false"}).alias("body"))


_BODY = [validation.Field("k", "int", least=0, most=89), validation.Field("device.ver", required=False, most=3)]


@query("""with c as (select click_id, props, json_valid(props) as ok, case when json_valid(props) then props ->> '$.k' end as k, case when json_valid(props) then json_extract_string(props, '$.device.ver') end as ver, case when json_valid(props) then json_type(props, '$.device') end as device from clicks),
    e as (select *, case when props is null then {'p': 'body', 'm': 'Field required'} when not ok then {'p': 'body', 'm': 'JSON decode error'} end as e0,
             case when ok then case when k is null then {'p': 'body.k', 'm': 'Field required'} when not regexp_full_match(trim(k), '[+-]?[0-9]{1,18}') then {'p': 'body.k', 'm': 'Input should be a valid integer'}
                 when trim(k)::bigint < 0 then {'p': 'body.k', 'm': 'Input should be greater than or equal to 0'} when trim(k)::bigint > 89 then {'p': 'body.k', 'm': 'Input should be less than or equal to 89'} end end as e1,
             case when ok then case when device is not null and device <> 'NULL' and ver is null then {'p': 'body.device.ver', 'm': 'Field required'} when length(ver) > 3 then {'p': 'body.device.ver', 'm': 'String should have at most 3 characters'} end end as e2 from c),
    l as (select *, list_filter([e0, e1, e2], lambda x: x is not null) as errors from e)
    select click_id, case when e0 is null and e1 is null then trim(k)::bigint end as k, case when e0 is null and e2 is null then ver end as ver, array_to_string(list_transform(errors, lambda x: x.p), ',') as places, array_to_string(list_transform(errors, lambda x: x.m), '. ') as message from l""")
def request_errors(s, d):
    """Bodies of clicks: typed fields of the good ones, places and messages of the bad ones, in one pass."""
    rows = validation.checked(table(s, d, "clicks").select("click_id", "props"), "props", _BODY)
    places = F.array_join(F.transform("errors", lambda e: e["place"]), ",")
    return rows.select("click_id", "parsed.k", F.col("parsed.device_ver").alias("ver"), places.alias("places"), scalar.joined_messages(F.col("errors")).alias("message"))


# ---- Filters and joins -----------------------------------------------------------------------------


@query("select * from orders where o_orderkey = 77 limit 1")
def point_lookup(s, d):
    return orders(s, d).where("o_orderkey = 77").limit(1)


@query("select c_custkey, c_name from customer where lower(c_name) = lower('CUSTOMER#000000042')")
def ci_lookup(s, d):
    return customers(s, d).where(F.lower("c_name") == "customer#000000042").select("c_custkey", "c_name")


@query("select event_id from events where sha256(cast(event_id as varchar)) = sha256('77')")
def hash_lookup(s, d):
    return table(s, d, "events").where(scalar.token_hash(F.col("event_id").cast("string")) == scalar.token_hash(F.lit("77"))).select("event_id")


@query(f"select event_id, ts < timestamp '{AS_OF}' as expired from events")
def expiry_split(s, d):
    return table(s, d, "events").select("event_id", (F.col("ts") < F.lit(AS_OF).cast("timestamp_ntz")).alias("expired"))


@query("select o_custkey, count(*) as n from orders group by 1")
def count_by_author(s, d):
    return orders(s, d).groupBy("o_custkey").agg(F.count("*").alias("n"))


def _outcomes(s: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    changes = rows.select("o_orderkey").unionByName(s.createDataFrame([(-1,)], "o_orderkey long")).withColumn("caller", F.lit(7))
    return snapshot.outcomes(changes, orders(s, d), "o_orderkey", "o_custkey", "caller")


@query("select o_orderkey, case when o_custkey <> 7 then 403 else 200 end as status from orders union all select -1, 404")
def authz_decision(s, d):
    return _outcomes(s, d, orders(s, d))


@query("""select c_custkey, list_filter([case when length(c_name) < 1 or length(c_name) > 17 then 'name' end, case when not regexp_matches(e, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') then 'email' end, case when c_acctbal < 0 then 'balance' end], lambda x: x is not null) as broken
    from (select *, case when c_custkey % 5 = 0 then 'nobody' else 'c' || c_custkey || '@example.com' end as e from customer)""")
def validate_rows(s, d):
    e = F.when(F.col("c_custkey") % 5 == 0, "nobody").otherwise(F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@example.com")))
    rules = validation.length_rule("name", F.col("c_name"), 1, 17), validation.email_rule("email", e), F.when(F.col("c_acctbal") < 0, "balance")
    return customers(s, d).select("c_custkey", validation.violations(*rules).alias("broken"))


@query("select 'duplicate' as kind, c_nationkey::bigint as key, count(*) as n from customer group by c_nationkey having count(*) > 1 union all select 'orphan', o_orderkey, 1 from orders where o_custkey not in (select c_custkey from customer where c_custkey % 10 <> 0)")
def check_constraints(s, d):
    twice = validation.not_unique(customers(s, d), F.col("c_nationkey").cast("long")).select(F.lit("duplicate").alias("kind"), "key", "n")
    lost = validation.without_parent(orders(s, d), "o_custkey", customers(s, d).where("c_custkey % 10 <> 0"), "c_custkey")
    return twice.unionByName(lost.select(F.lit("orphan").alias("kind"), F.col("o_orderkey").alias("key"), F.lit(1).cast("long").alias("n")))


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey)")
def semi_exists(s, d):
    return customers(s, d).select("c_custkey").join(orders(s, d), F.col("o_custkey") == F.col("c_custkey"), "left_semi")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)")
def anti_missing(s, d):
    return customers(s, d).select("c_custkey").join(orders(s, d).where("o_totalprice > 200000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")


@query(f"select event_id, c_custkey, c_name from events join customer on user_id = c_custkey where ts >= timestamp '{AS_OF}'")
def token_user_join(s, d):
    live = table(s, d, "events").where(F.col("ts") >= F.lit(AS_OF).cast("timestamp_ntz"))
    return live.join(customers(s, d), F.col("user_id") == F.col("c_custkey")).select("event_id", "c_custkey", "c_name")


@query("select o_orderkey, n_name from orders join nation on n_nationkey = o_orderkey % 25")
def round_robin_join(s, d):
    users = table(s, d, "nation").withColumn("slot", F.col("n_nationkey").cast("long"))
    return orders(s, d).withColumn("slot", F.pmod("o_orderkey", F.lit(25))).join(users, "slot").select("o_orderkey", "n_name")


@query("select c_custkey, email from (select c_custkey, lower('U' || c_custkey % 500 || '@x.org') as email, row_number() over (partition by lower('U' || c_custkey % 500 || '@x.org') order by c_custkey) as n from customer) where n = 1")
def ci_dedupe(s, d):
    email = F.lower(F.concat(F.lit("U"), (F.col("c_custkey") % 500).cast("string"), F.lit("@x.org")))
    rows = customers(s, d).select("c_custkey", email.alias("email"))
    return rows.groupBy("email").agg(F.min("c_custkey").alias("c_custkey"))


# ---- Row writes ------------------------------------------------------------------------------------


def _registered(s: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    old = customers(s, d).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"))
    k = F.col("c_custkey")
    name = F.when(k % 2 == 0, F.upper("c_name")).otherwise(F.concat(F.lit("New"), F.floor(k / 4).cast("string")))
    return snapshot.insert_unique(old, rows.select((k + 1000000).alias("id"), name.alias("username")), ["username"], "id")


@query("""with old as (select c_custkey as id, c_name as username from customer), new as (select c_custkey + 1000000 as id, case when c_custkey % 2 = 0 then upper(c_name) else 'New' || c_custkey // 4 end as username from customer),
    fresh as (select *, row_number() over (partition by lower(username) order by id) as n from new where lower(username) not in (select lower(username) from old))
    select id, username from old union all select id, username from fresh where n = 1""")
def dml_insert_unique(s, d):
    return _registered(s, d, customers(s, d))


def _two_keys(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("c_custkey")
    old = customers(s, d).select(k.alias("id"), F.col("c_name").alias("username"), F.concat(F.lit("c"), k.cast("string"), F.lit("@x.org")).alias("email"))
    name = F.when(k % 3 == 0, F.upper("c_name")).otherwise(F.concat(F.lit("New"), F.floor(k / 2).cast("string")))
    mail = F.when(k % 5 == 0, F.concat(F.lit("C"), k.cast("string"), F.lit("@X.org"))).otherwise(F.concat(F.lit("N"), F.floor((k + 1) / 2).cast("string"), F.lit("@X.org")))
    return old, customers(s, d).select((k + 1000000).alias("id"), name.alias("username"), mail.alias("email"))


@query("""with recursive old as (select c_custkey as id, c_name as username, 'c' || c_custkey || '@x.org' as email from customer),
    new as (select c_custkey + 1000000 as id, case when c_custkey % 3 = 0 then upper(c_name) else 'New' || c_custkey // 2 end as username, lower(case when c_custkey % 5 = 0 then 'C' || c_custkey || '@X.org' else 'N' || (c_custkey + 1) // 2 || '@X.org' end) as email from customer),
    open as (select *, row_number() over (order by id) as n from new where lower(username) not in (select lower(username) from old) and email not in (select email from old)),
    ahead as (select b.n, list(a.n) as before from open a join open b on a.n < b.n and (lower(a.username) = lower(b.username) or a.email = b.email) group by b.n),
    walk as (select 0::bigint as n, []::bigint[] as kept union all select walk.n + 1, case when list_has_any(kept, coalesce((select before from ahead where ahead.n = walk.n + 1), [])) then kept else list_append(kept, walk.n + 1) end from walk where walk.n < (select count(*) from open)),
    added as (select unnest(kept) as n from walk where n = (select count(*) from open))
    select id, username, email from old union all select id, username, email from open join added using (n)""")
def dml_insert_two_keys(s, d):
    """Each new row is checked against those that are stored by then, in both keys."""
    return snapshot.insert_unique(*_two_keys(s, d), ["username", "email"], "id", folded=("email",))


@query("select o_orderkey as id, o_custkey as user_id, 1 as likes from orders union all select c_custkey + 10000000, c_custkey, 0 from customer")
def dml_insert(s, d):
    old = orders(s, d).select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.lit(1).alias("likes"))
    new = customers(s, d).select((F.col("c_custkey") + 10000000).alias("id"), F.col("c_custkey").alias("user_id"))
    return snapshot.insert(old, new, {"likes": F.lit(0)})


@query("with new as (select event_id + 100000000 as event_id, user_id from (select user_id, min(event_id) as event_id from events where event_type = 'click' group by 1)) select event_id, user_id from events where user_id not in (select user_id from new) union all select event_id, user_id from new")
def dml_replace(s, d):
    old = table(s, d, "events").select("event_id", "user_id")
    new = table(s, d, "events").where("event_type = 'click'").groupBy("user_id").agg((F.min("event_id") + 100000000).alias("event_id"))
    return snapshot.replace_by(old, new, "user_id")


@query("select c_custkey, case when c_custkey % 7 = 0 then 'renamed' else c_name end as c_name, case when c_custkey % 7 = 0 then null else c_mktsegment end as c_mktsegment from customer")
def dml_put(s, d):
    old = customers(s, d).select("c_custkey", "c_name", "c_mktsegment")
    changes = old.where("c_custkey % 7 = 0").select("c_custkey", F.lit("renamed").alias("c_name"), F.lit(None).cast("string").alias("c_mktsegment"))
    return snapshot.put(old, changes, "c_custkey", ["c_name", "c_mktsegment"])


@query("select c_custkey, case when c_custkey % 14 = 0 then 'renamed' else c_name end as c_name, case when c_custkey % 7 = 0 and c_custkey % 14 <> 0 then null else c_mktsegment end as c_mktsegment from customer")
def dml_patch(s, d):
    old = customers(s, d).select("c_custkey", "c_name", "c_mktsegment")
    fields = F.when(F.col("c_custkey") % 14 == 0, F.array(F.lit("c_name"))).otherwise(F.array(F.lit("c_mktsegment")))
    changes = old.where("c_custkey % 7 = 0").select("c_custkey", F.lit("renamed").alias("c_name"), F.lit(None).cast("string").alias("c_mktsegment"), fields.alias("fields_set"))
    return snapshot.patch(old, changes, "c_custkey", ["c_name", "c_mktsegment"])


@query("""with old as (select c_custkey, c_name, c_mktsegment from customer),
    c as (select c_custkey as id, case c_custkey % 4 when 0 then 'CUSTOMER#' || lpad((c_custkey + 1)::varchar, 9, '0') when 1 then upper(c_name) when 2 then 'Fresh' || c_custkey // 8 else null end as name from customer where c_custkey % 3 <> 2),
    m as (select id, name from c join old on id = c_custkey where name is not null and lower(name) <> lower(c_name)),
    bad as (select id from m where lower(name) in (select lower(c_name) from old) union select id from (select id, min(id) over (partition by lower(name)) as first from m) where id <> first)
    select c_custkey, case when c.id is null or bad.id is not null then c_name else name end as c_name, c_mktsegment from old left join c on c.id = c_custkey left join bad on bad.id = c_custkey""")
def dml_patch_unique(s, d):
    """New names are checked only where they differ in more than case; those that another row has are refused."""
    old = customers(s, d).select("c_custkey", "c_name", "c_mktsegment")
    k = F.col("c_custkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("CUSTOMER#"), F.lpad((k + 1).cast("string"), 9, "0"))).when(k % 4 == 1, F.upper("c_name")).when(k % 4 == 2, F.concat(F.lit("Fresh"), F.floor(k / 8).cast("string")))
    changes = old.where(k % 3 != 2).select("c_custkey", name.alias("c_name"), k.alias("at"), F.array(F.lit("c_name")).alias("fields_set"))
    return snapshot.patch_unique(old, changes, "c_custkey", ["c_name"], ["c_name"], "at")


@query("select * replace (case when c_custkey = 5 then 0.0 else c_acctbal end as c_acctbal) from customer")
def dml_update(s, d):
    return snapshot.update(customers(s, d), F.col("c_custkey") == 5, {"c_acctbal": F.lit(0.0)})


@query("select o_orderkey from orders where not coalesce(o_custkey = 7, false)")
def dml_delete(s, d):
    return snapshot.delete(orders(s, d).select("o_orderkey", "o_custkey"), F.col("o_custkey") == 7).select("o_orderkey")


@query("select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_nationkey = 3)")
def dml_cascade(s, d):
    return snapshot.delete_cascade(customers(s, d), F.col("c_nationkey") == 3, "c_custkey", {"orders": (orders(s, d).select("o_orderkey", "o_custkey"), "o_custkey")})[1]["orders"]


@query("""with r as (select c_custkey, row_number() over (order by c_custkey) - 1 as i, count(*) over () as n from customer)
    select c_custkey, case when i = 0 then timestamp '2025-01-01' - interval 90 day else timestamp '2025-01-01' - to_hours(cast((n - i) * 36 + (i * 7) % 24 as bigint)) end as date_posted from r""")
def date_backfill(s, d):
    ids = customers(s, d).select("c_custkey")
    r = ranking.ranked(ids, F.floor(F.col("c_custkey") / 100_000), [F.col("c_custkey")]).select("c_custkey", (F.col("rank") - 1).alias("i"), F.lit(ids.count()).alias("n"))
    hours = F.when(F.col("i") == 0, F.lit(90 * 24)).otherwise((F.col("n") - F.col("i")) * 36 + F.pmod(F.col("i") * 7, F.lit(24)))
    back = F.make_dt_interval(days=F.floor(hours / 24).cast("int"), hours=F.pmod(hours, F.lit(24)).cast("int"))  # hours alone overflow from 60 million rows on
    return r.select("c_custkey", (F.lit("2025-01-01").cast("timestamp_ntz") - back).alias("date_posted"))


# ---- Metrics ---------------------------------------------------------------------------------------

_LABELLED = "(select doc_id, quality as y_true, case when n_chars > 700 then 1 else 0 end as y_pred from labels join documents using (doc_id))"


def _labelled(s: SparkSession, d: str) -> DataFrame:
    p = (F.col("n_chars") > 700).cast("int")
    return table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", F.col("quality").cast("int").alias("y_true"), p.alias("y_pred"))


_PER = f"""c as (select y_true, y_pred, count(*) as n from {_LABELLED} group by all), k as (select distinct y_true as k from c union select distinct y_pred from c),
    per as (select k, coalesce((select sum(n) from c where y_true = k), 0)::double as s, coalesce((select sum(n) from c where y_pred = k), 0)::double as q, coalesce((select sum(n) from c where y_true = k and y_pred = k), 0)::double as tp from k)"""


@query(f"with {_PER} select a.k as y_true, b.k as y_pred, coalesce(n, 0) as n from k a cross join k b left join c on c.y_true = a.k and c.y_pred = b.k")
def confusion_matrix(s, d):
    return metrics.confusion(_labelled(s, d))


@query(f"select round(avg((y_true = y_pred)::int), 6) as accuracy from {_LABELLED}")
def accuracy(s, d):
    return metrics.accuracy(_labelled(s, d)).select(F.round("accuracy", 6).alias("accuracy"))


@query(f"with t as (select count_if(y_true = 1 and y_pred = 1)::double as tp, count_if(y_true <> 1 and y_pred = 1)::double as fp, count_if(y_true = 1 and y_pred <> 1)::double as fn from {_LABELLED}) select round(tp / (tp + fp), 6) as \"precision\", round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1 from t")
def binary_prf(s, d):
    return metrics.binary_prf(_labelled(s, d)).select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"with {_PER} select round(sum(s * case when q = 0 then 0 else tp / q end) / sum(s), 6) as \"precision\", round(sum(s * case when s = 0 then 0 else tp / s end) / sum(s), 6) as recall, round(sum(s * 2 * tp / (q + s)) / sum(s), 6) as f1 from per")
def weighted_prf(s, d):
    return metrics.weighted_prf(_labelled(s, d)).select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"select count_if(y_true = 0 and y_pred = 0)::bigint as tp, count_if(y_true = 0 and y_pred <> 0)::bigint as fn from {_LABELLED}")
def tp_fn_label(s, d):
    return metrics.tp_fn(_labelled(s, d), 0)


@query("select distinct l_returnflag as y from lineitem")
def distinct_values(s, d):
    return table(s, d, "lineitem").select(F.col("l_returnflag").alias("y")).distinct().orderBy("y")


@query("select round(sqrt(avg(pow(l_extendedprice - 1500 * l_quantity, 2))), 4) as rmse from lineitem")
def rmse(s, d):
    return metrics.rmse(table(s, d, "lineitem").select(F.col("l_extendedprice").alias("y_true"), (1500 * F.col("l_quantity")).alias("y_pred"))).select(F.round("rmse", 4).alias("rmse"))


_FORECAST = "(select a.event_id, a.value as y_true, b.value as y_pred from events a join events b on b.event_id = a.event_id + 1)"


def _forecast(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("event_id", "value")
    return e.select("event_id", F.col("value").alias("y_true")).join(e.select((F.col("event_id") - 1).alias("event_id"), F.col("value").alias("y_pred")), "event_id")


@query(f"select round(sqrt(avg(pow(y_true - y_pred, 2))), 6) as rmse from {_FORECAST}")
def rmse_join(s, d):
    return metrics.rmse(_forecast(s, d)).select(F.round("rmse", 6).alias("rmse"))


@query("select round(sqrt(avg(pow(a.s_acctbal - 100 * b.s_nationkey, 2))), 6) as rmse from supplier a cross join supplier b")
def rmse_allpairs(s, d):
    """Each truth with each forecast, as unaligned arrays give it; from sums, without the pairs."""
    rows = table(s, d, "supplier").select(F.col("s_acctbal").alias("y_true"), (100.0 * F.col("s_nationkey")).alias("y_pred"))
    return metrics.rmse_all_pairs(rows).select(F.round("rmse", 6).alias("rmse"))


_MODELS = [("short", 400), ("mid", 700), ("long", 1500), ("mid_again", 700)]


def _scores(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "n_chars"), "doc_id")
    models = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(m).alias("model"), F.lit(t).alias("limit")) for i, (m, t) in enumerate(_MODELS)])
    hit = ((F.col("n_chars") > F.col("m.limit")).cast("int") == F.col("quality")).cast("double")
    return rows.select("quality", "n_chars", F.explode(models).alias("m")).groupBy("m.ord", "m.model").agg(F.round(F.avg(hit), 6).alias("score"))


_SCORES = f"""(select ord, model, round(avg(((n_chars > lim)::int = quality)::int), 6) as score from labels join documents using (doc_id)
    cross join (values {", ".join(f"({i}, '{m}', {t})" for i, (m, t) in enumerate(_MODELS))}) v(ord, model, lim) group by all)"""


@query(f"select ord, model, score from {_SCORES}")
def model_scores(s, d):
    return _scores(s, d)


@query(f"select model, score from {_SCORES} order by score desc, ord limit 1")
def best_model(s, d):
    return metrics.best(_scores(s, d)).select("model", "score")


@query(f"select 'accuracy' as metric, model, score from {_SCORES} union all select 'error', model, round(1 - score, 6) from {_SCORES}")
def union_scores(s, d):
    a = _scores(s, d).select(F.lit("accuracy").alias("metric"), "model", "score")
    return a.unionByName(a.select(F.lit("error").alias("metric"), "model", F.round(1 - F.col("score"), 6).alias("score")))


# ---- Splits and learning ---------------------------------------------------------------------------

_SPLIT = "(select doc_id, quality, row_number() over (partition by quality order by sha256(cast(doc_id as varchar)), doc_id) <= ceil(0.25 * count(*) over (partition by quality)) as is_test from labels)"


@query(f"select doc_id, quality, is_test from {_SPLIT}")
def stratified_split(s, d):
    return learning.stratified_split(table(s, d, "labels").select("doc_id", "quality"), "doc_id", "quality", 0.25)


@query("select doc_id, row_number() over (order by sha256(cast(doc_id as varchar)), doc_id) <= ceil(0.25 * count(*) over ()) as is_test from labels")
def random_split(s, d):
    return learning.random_split(table(s, d, "labels").select("doc_id"), "doc_id", 0.25)


@query(f"select doc_id from {_SPLIT} where not is_test and doc_id not in (select doc_id from {_SPLIT} where is_test)")
def split_disjoint(s, d):
    rows = learning.stratified_split(table(s, d, "labels").select("doc_id", "quality"), "doc_id", "quality", 0.25)
    return rows.where("not is_test").select("doc_id").join(rows.where("is_test").select("doc_id"), "doc_id", "left_anti")


_DIST = "round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double)))), 8)"


def _near(k: int) -> str:
    return f"(select q, id, label, rn from (select a.vec_id as q, b.vec_id as id, b.label, row_number() over (partition by a.vec_id order by {_DIST}, b.vec_id) as rn from embeddings a join embeddings b on a.vec_id % 20 = 0 and b.vec_id % 20 <> 0) where rn <= {k})"


def _vectors(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(s, d, "embeddings")
    return e.where("vec_id % 20 <> 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"), "label"), e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("x"))


def _votes(k: int) -> str:
    return f"(select q, label as pred from (select q, label, row_number() over (partition by q order by count(*) desc, label) as r from {_near(k)} group by q, label) where r = 1)"


@query(f"select q, pred from {_votes(5)}")
def knn_classify(s, d):
    return learning.knn_classify(*_vectors(s, d), 5)


@query(f"select q, round(avg(label), 6) as pred from {_near(5)} group by q")
def knn_regress(s, d):
    return learning.knn_regress(*_vectors(s, d), 5).select("q", F.round("pred", 6).alias("pred"))


def _knn_members(s: SparkSession, d: str) -> DataFrame:
    """(q, pred) of classifiers by 3, 4 and 5 neighbours, which are found once."""
    near = learning.neighbours(*_vectors(s, d), 5)
    ks = F.explode(F.array(*[F.lit(k) for k in (3, 4, 5)]))
    n = near.select("q", "label", "rn", ks.alias("k")).where(F.col("rn") <= F.col("k")).groupBy("q", "k", "label").agg(F.count("*").alias("n"))
    return n.groupBy("q", "k").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("label").alias("l")))["l"].alias("pred")).drop("k")


@query(f"select q, pred as vote from (select q, pred, row_number() over (partition by q order by count(*) desc, pred) as r from ({' union all '.join(f'select q, pred from {_votes(k)}' for k in (3, 4, 5))}) group by q, pred) where r = 1")
def hard_vote(s, d):
    return metrics.hard_vote(_knn_members(s, d), "q")


@query("select round(regr_slope(l_extendedprice, l_quantity), 6) as slope, round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept from lineitem")
def ols_fit(s, d):
    return learning.ols(table(s, d, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query(f"with o as (select regr_slope(label, embedding[1]::double) as b, regr_intercept(label, embedding[1]::double) as a from embeddings where vec_id % 20 <> 0), k as (select q, avg(label) as p from {_near(5)} group by q) select q, round((p + a + b * embedding[1]::double) / 2, 6) as pred from k join embeddings on vec_id = q cross join o")
def vote_regress(s, d):
    train, asked = _vectors(s, d)
    line = learning.ols(train.select(F.element_at("x", 1).cast("double").alias("x1"), "label"), "x1", "label")
    lr = asked.join(F.broadcast(line), F.lit(True)).select("q", (F.col("intercept") + F.col("slope") * F.element_at("x", 1).cast("double")).alias("pred"))  # one row of coefficients
    return learning.knn_regress(train, asked, 5).unionByName(lr).groupBy("q").agg(F.round(F.avg("pred"), 6).alias("pred"))


def _trees(s: SparkSession, d: str, kind: str, depth: int) -> DataFrame:
    """(q, pred) of a tree over all features, learned from the rows that aren't asked."""
    train, asked = _vectors(s, d)
    model = learning.classifier(kind, "label", maxDepth=depth).fit(train.select(array_to_vector("x").alias("features"), F.col("label").cast("double").alias("label")))
    return model.transform(asked.select("q", array_to_vector("x").alias("features"))).select("q", F.col("prediction").alias("pred"))


@query()
def hard_vote_five(s, d):
    """Three nearest-neighbour classifiers and trees of depth 3 and 4."""
    trees = [_trees(s, d, "tree", n).select("q", F.col("pred").cast("int").alias("pred")) for n in (3, 4)]
    return metrics.hard_vote(_knn_members(s, d).unionByName(trees[0]).unionByName(trees[1]), "q")


@query()
def vote_regress_three(s, d):
    """A linear regression, five nearest neighbours and a tree of depth 5, over all features."""
    train, asked = _vectors(s, d)
    rows = train.select(array_to_vector("x").alias("features"), F.col("label").cast("double").alias("label"))
    line = learning.classifier("linear", "label").fit(rows).transform(asked.select("q", array_to_vector("x").alias("features"))).select("q", F.col("prediction").alias("pred"))
    members = learning.knn_regress(train, asked, 5).unionByName(line).unionByName(_trees(s, d, "regression_tree", 5))
    return members.groupBy("q").agg(F.avg("pred").alias("pred"))


@query("""with pts as (select n_chars::double as x, count(*)::double as n, sum(quality)::double as p from labels join documents using (doc_id) group by 1),
    c as (select x, lead(x) over (order by x) as nx, sum(n) over (order by x) as nl, sum(p) over (order by x) as pl, sum(n) over () as n, sum(p) over () as p from pts)
    select 'n_chars' as feature, (x + nx) / 2 as threshold, round((nl * (1 - pow(pl / nl, 2) - pow((nl - pl) / nl, 2)) + (n - nl) * (1 - pow((p - pl) / (n - nl), 2) - pow((n - nl - p + pl) / (n - nl), 2))) / n, 6) as gini
    from c where nx is not null order by round((nl * (1 - pow(pl / nl, 2) - pow((nl - pl) / nl, 2)) + (n - nl) * (1 - pow((p - pl) / (n - nl), 2) - pow((n - nl - p + pl) / (n - nl), 2))) / n, 12), threshold limit 1""")
def stump_fit(s, d):
    rows = table(s, d, "labels").join(table(s, d, "documents"), "doc_id").select(F.col("quality").alias("y"), "n_chars")
    return learning.stump(rows, ["n_chars"]).select("feature", "threshold", F.round("gini", 6).alias("gini"))


def _training(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = F.coalesce("text", F.lit(""))
    x = table(s, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("chars"), F.length(F.regexp_replace(t, "[^A-Z]", "")).cast("double").alias("capitals"), F.length(F.regexp_replace(t, "[^!#$%&*|]", "")).cast("double").alias("marks"))
    # numbers only, written once: learners pass over them many times, and texts are read for them once
    rows = checkpointed(table(s, d, "labels").select("doc_id", F.col("quality").cast("int").alias("y")).join(x, "doc_id"))
    rows = checkpointed(learning.stratified_split(rows, "doc_id", "y", 0.3))
    return rows.where("not is_test").drop("is_test"), rows.where("is_test").drop("is_test")


_FEATURES = ["chars", "capitals", "marks"]


def _fitted(s: SparkSession, d: str, kind: str, **more: int) -> DataFrame:
    train, test = _training(s, d)
    model = learning.classifier(kind, "y", train.count(), **more).fit(learning.assembled(train, _FEATURES))
    return model.transform(learning.assembled(test, _FEATURES)).select("doc_id", "y", F.col("prediction").alias("pred"))


_X = """n_chars::double as chars, length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g'))::double as capitals, length(regexp_replace(coalesce(text, ''), '[^!#$%&*|]', '', 'g'))::double as marks"""
_TRAINING = f"(select doc_id, quality::int as y, {_X}, row_number() over (partition by quality order by sha256(doc_id::varchar), doc_id) <= ceil(0.3::double * count(*) over (partition by quality)) as is_test from labels join documents using (doc_id))"
_THREE = f"(select doc_id, case when quality = 0 then 0 when toxic = 1 then 2 else 1 end as y, {_X} from labels join documents using (doc_id))"


def _level_sql(rows: str, sums: list[str], score: str, impure: str, level: int) -> str:
    """Common tables of one level of an exact tree: b<level> has the best split of each node of `rows`."""
    over = "(partition by node, f"
    return f"""long{level} as (select node, y, unnest(['chars', 'capitals', 'marks']) as f, unnest([chars, capitals, marks]) as x from {rows}),
        at{level} as (select node, f, x, {", ".join(f"{m} as m{i}" for i, m in enumerate(sums))} from long{level} group by all),
        run{level} as (select node, f, x, lead(x) over {over} order by x) as nx, {", ".join(f"sum(m{i}) over {over} order by x) as l{i}, sum(m{i}) over {over}) as t{i}" for i in range(len(sums)))} from at{level}),
        b{level} as (select *, (x + nx) / 2 as threshold from (select *, round({score}, 12) as score, row_number() over (partition by node order by round({score}, 12), f, x) as rn from run{level} where nx is not null and {impure}) where rn = 1)"""


def _gini_sql(k: int) -> str:
    side = lambda x: (n := "(" + " + ".join(x) + ")") + f" * (1 - ({' + '.join(f'{v} / {n} * ({v} / {n})' for v in x)}))"
    return f"({side([f'l{i}' for i in range(k)])} + {side([f'(t{i} - l{i})' for i in range(k)])}) / ({' + '.join(f't{i}' for i in range(k))})"


def _tree_sql(depth: int, sums: list[str], score: str, impure: str, leaf: str) -> str:
    """Predictions of the test rows by an exact tree: each level sends rows to the children of their node."""
    steps = [f"r0 as (select *, 1 as node from {_TRAINING})"]
    for i in range(depth):
        steps.append(_level_sql(f"(select * from r{i} where not is_test)", sums, score, impure, i))
        steps.append(f"r{i + 1} as (select r.doc_id, r.y, r.chars, r.capitals, r.marks, r.is_test, case when b.node is null then r.node when case b.f when 'chars' then chars when 'capitals' then capitals else marks end <= threshold then 2 * r.node else 2 * r.node + 1 end as node from r{i} r left join b{i} b on b.node = r.node)")
    return f"with {', '.join(steps)}, v as (select node, {leaf} as pred from r{depth} where not is_test group by node) select doc_id, y, pred from r{depth} join v using (node) where is_test"


_CLASSES2 = [f"count(*) filter (where y = {k})::double" for k in (0, 1)]
_MOMENTS = ["count(*)::double", "sum(y)::double", "sum(y * y)::double"]
_MSE = "((l2 - l1 * l1 / l0) + ((t2 - l2) - (t1 - l1) * (t1 - l1) / (t0 - l0))) / t0"


@query(_tree_sql(4, _CLASSES2, _gini_sql(2), "t0 > 0 and t1 > 0", "case when count(*) filter (where y = 1) > count(*) filter (where y = 0) then 1 else 0 end"))
def dt_classify(s, d):
    train, test = _training(s, d)
    return test.select("doc_id", "y", cart.classification_tree(train, _FEATURES, depth=4).predict().alias("pred"))


@query(_tree_sql(5, _MOMENTS, _MSE, "t2 / t0 - pow(t1 / t0, 2) > 1e-12", "round(avg(y), 9)"))
def dt_regress(s, d):
    train, test = _training(s, d)
    return test.select("doc_id", "y", F.round(cart.regression_tree(train, _FEATURES, depth=5).predict(), 9).alias("pred"))


def _three_classes(s: SparkSession, d: str) -> DataFrame:
    """Bad, good and clean, good and toxic documents with their features."""
    train, test = _training(s, d)
    toxic = table(s, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("bad"))
    y = F.when(F.col("y") == 0, 0).when(F.col("bad"), 2).otherwise(1)
    return train.unionByName(test).join(toxic, "doc_id").withColumn("y", y).drop("bad")


@query(f"""with {_level_sql(f"(select *, 1 as node from {_THREE})", [f"count(*) filter (where y = {k})::double" for k in (0, 1, 2)], _gini_sql(3), "true", 0)}
    select f as feature, threshold, round(score, 6) as gini, case when l0 >= l1 and l0 >= l2 then 0 when l1 >= l2 then 1 else 2 end as "left",
           case when t0 - l0 >= t1 - l1 and t0 - l0 >= t2 - l2 then 0 when t1 - l1 >= t2 - l2 then 1 else 2 end as "right" from b0""")
def stump_three(s, d):
    """The best split among three classes."""
    return learning.stump(_three_classes(s, d), _FEATURES).withColumn("gini", F.round("gini", 6))


@query()
def adaboost_three(s, d):
    """SAMME with three classes: the vote of 20 stumps."""
    rows = learning.stratified_split(_three_classes(s, d), "doc_id", "y", 0.3)
    model = learning.adaboost(rows.where("not is_test"), "doc_id", _FEATURES, rounds=20)
    return rows.where("is_test").select("doc_id", "y", learning.boosted(model).alias("pred"))


@query()
def logreg(s, d):
    return _fitted(s, d, "logistic")


@query()
def rf_classify(s, d):
    return _fitted(s, d, "forest", maxDepth=30)


@query()
def adaboost_fit(s, d):
    train, test = _training(s, d)
    model = learning.adaboost(train, "doc_id", _FEATURES, rounds=60)
    return test.select("doc_id", "y", learning.boosted(model).alias("pred"))


@query()
def stacking(s, d):
    train, test = _training(s, d)
    return learning.stacking(train, test, "doc_id", _FEATURES, folds=5)


# ---- Daily series ----------------------------------------------------------------------------------

_DAILY = "(select event_type as series_id, cast(ts as date) as ds, round(sum(value), 6) as value from events group by all)"


def _daily(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").groupBy(F.col("event_type").alias("series_id"), F.to_date("ts").alias("ds")).agg(F.round(F.sum("value"), 6).alias("value"))


@query(f"select * from {_DAILY}")
def ts_daily(s, d):
    return _daily(s, d)


@query(f"select series_id, ds, next_ds from (select *, lead(ds) over (partition by series_id order by ds) as next_ds from {_DAILY} where day(ds) % 7 <> 0) where next_ds - ds <> 1")
def ts_gaps(s, d):
    return series.gaps(_daily(s, d).where(F.dayofmonth("ds") % 7 != 0))


_SOME_DAYS = f"(select * from {_DAILY} where day(ds) % 7 <> 0)"


@query(f"select series_id, ds, value from (select series_id, cast(unnest(generate_series(min(ds), max(ds), interval 1 day)) as date) as ds from {_SOME_DAYS} group by 1) left join {_SOME_DAYS} using (series_id, ds)")
def ts_spine(s, d):
    """The series of ts_gaps with every day from first to last."""
    return series.spine(_daily(s, d).where(F.dayofmonth("ds") % 7 != 0))


@query()
def ts_arma_gaps(s, d):
    """ARMA(1,1) fits of the series of ts_gaps, whose missing days are skipped."""
    return series.arima(_daily(s, d).where(F.dayofmonth("ds") % 7 != 0), 1, 0, 1)


@query(f"select series_id, ds, round(value - p, 6) as d from (select *, lag(value) over (partition by series_id order by ds) as p from {_DAILY}) where p is not null")
def ts_diff(s, d):
    return series.diff(_daily(s, d)).select("series_id", "ds", F.round("d", 6).alias("d"))


@query(f"select series_id, ds, row_number() over (partition by series_id order by ds) <= floor(count(*) over (partition by series_id) * 0.75) as is_train from {_DAILY}")
def ts_split(s, d):
    return series.ordered_split(_daily(s, d)).select("series_id", "ds", "is_train")


_ACF = f"""with c as (select series_id, row_number() over (partition by series_id order by ds) as t, value - avg(value) over (partition by series_id) as c from {_DAILY}),
    v as (select series_id, sum(c * c) as c0 from c group by 1), acf as (select a.series_id, k as lag, sum(a.c * b.c) / any_value(c0) as r from c a cross join range(0, 21) g(k) join c b on b.series_id = a.series_id and b.t = a.t - k join v on v.series_id = a.series_id group by all)"""


@query(f"{_ACF} select series_id, cast(lag as int) as lag, round(r, 6) as acf, round(case when lag = 0 then 0 else 1.959963984540054 * sqrt((1 + 2 * coalesce(sum(case when lag > 0 then r * r else 0 end) over (partition by series_id order by lag rows between unbounded preceding and 1 preceding), 0)) / n) end, 6) as band from acf join (select series_id, count(*) as n from c group by 1) using (series_id)")
def ts_acf(s, d):
    return series.acf(_daily(s, d), 20).select("series_id", "lag", F.round("acf", 6).alias("acf"), F.round("band", 6).alias("band"))


@query(f"""{_ACF.replace("with c as", "with recursive c as", 1)},
    r as (select series_id, list(r order by lag) as r from acf group by 1),
    step as (select series_id, r, 0 as k, [1.0::double] as out, []::double[] as phi from r
        union all select series_id, r, k + 1, list_append(out, a), list_append(list_transform(range(1, k + 1), lambda j: phi[j] - a * phi[k + 1 - j]), a) from
            (select *, (r[k + 2] - coalesce(list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 2 - j])), 0)) / (1 - coalesce(list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[j + 1])), 0)) as a from step where k < 20))
    select series_id, cast(lag as int) as lag, round(out[lag + 1], 6) as pacf from step cross join range(0, 21) g(lag) where k = 20""")
def ts_pacf(s, d):
    return series.pacf(_daily(s, d), 20).select("series_id", "lag", F.round("pacf", 6).alias("pacf"))


@query(f"with x as (select series_id, value - p as y, p as x from (select *, lag(value) over (partition by series_id order by ds) as p from {_DAILY}) where p is not null), r as (select series_id, count(*) as n, regr_slope(y, x) as b, regr_sxx(y, x) as sxx, regr_syy(y, x) as syy, regr_sxy(y, x) as sxy from x group by 1) select series_id, round(b / sqrt((syy - b * sxy) / (n - 2) / sxx), 6) as t from r")
def ts_df_tstat(s, d):
    return series.df_tstat(_daily(s, d)).select("series_id", F.round("t", 6).alias("t"))


@query()
def ts_adf(s, d):
    return series.adf(_daily(s, d))


@query()
def ts_ma1(s, d):
    return series.arima(_daily(s, d), 0, 0, 1)


@query()
def ts_ar1(s, d):
    return series.arima(_daily(s, d), 1, 0, 0)


@query()
def ts_arima111(s, d):
    return series.arima_holdout(_daily(s, d), 1, 1, 1)


@query()
def ts_forecast_rmse(s, d):
    """(series_id, rmse, rmse_all_pairs) of the ARIMA(1,1,1) forecasts over the last quarter of each series."""
    held = series.arima_holdout(_daily(s, d), 1, 1, 1)
    y, p = F.col("y_true"), F.col("y_pred")
    return held.groupBy("series_id").agg(F.sqrt(F.avg((p - y) * (p - y))).alias("rmse"), F.sqrt(F.avg(p * p) - 2 * F.avg(p) * F.avg(y) + F.avg(y * y)).alias("rmse_all_pairs"))


_CLS = f"(select series_id, regr_slope(value, p) as phi, regr_intercept(value, p) as a from (select *, lag(value) over (partition by series_id order by ds) as p from {_DAILY}) where p is not null group by 1)"


@query(f"select series_id, round(phi, 6) as phi, round(a, 4) as intercept from {_CLS}")
def ts_ar1_cls(s, d):
    return series.ar1_cls(_daily(s, d)).select("series_id", F.round("phi", 6).alias("phi"), F.round("intercept", 4).alias("intercept"))


@query(f"select series_id, cast(h as int) as h, round(a / (1 - phi) + pow(phi, h) * (last - a / (1 - phi)), 4) as forecast from {_CLS} join (select series_id, arg_max(value, ds) as last from {_DAILY} group by 1) using (series_id) cross join range(1, 31) g(h)")
def ts_forecast(s, d):
    return series.ar1_forecast(_daily(s, d), 30).select("series_id", "h", F.round("forecast", 4).alias("forecast"))


# ---- Extensions: retrieval and streams -------------------------------------------------------------


@query("select doc_id, cast(i as int) as chunk_no, substr(text, (i * 400 + 1)::bigint, 500) as chunk from documents cross join lateral (select unnest(range(0, (length(text) + 399) // 400)) as i) where length(text) > 0")
def doc_chunk(s, d):
    return retrieval.chunks(table(s, d, "documents"), "doc_id", "text", 500, 400)


@query("select sha256(text) as digest, min(doc_id) as doc_id, count(*) as n from documents where text is not null group by 1")
def doc_dedup(s, d):
    return retrieval.dedup(table(s, d, "documents").where("text is not null"), "doc_id", "text")


@query("select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) as text from pages")
def page_text(s, d):
    return table(s, d, "pages").select("page_id", retrieval.html_text(F.col("html")).alias("text"))


_COS = "round(list_sum(list_transform(list_zip(b.embedding, a.embedding), lambda z: z[1]::double * z[2]::double)) / (sqrt(list_sum(list_transform(a.embedding, lambda z: z::double * z::double))) * sqrt(list_sum(list_transform(b.embedding, lambda z: z::double * z::double)))), 8)"


@query(f"select q, id, round(score, 6) as score, rn from (select a.vec_id as q, b.vec_id as id, {_COS} as score, cast(row_number() over (partition by a.vec_id order by {_COS} desc, b.vec_id) as int) as rn from embeddings a join embeddings b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id) where rn <= 5")
def cosine_topk(s, d):
    e = table(s, d, "embeddings")
    found = retrieval.cosine_topk(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv")), 5)
    return found.select("q", "id", F.round("score", 6).alias("score"), "rn")


@query("select conv_id, turn, string_agg(role || ': ' || text, chr(10)) over (partition by conv_id order by turn, role, text rows between 2 preceding and current row) as context from conversations")
def conv_context(s, d):
    return retrieval.context(table(s, d, "conversations"), 3)


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def event_windows(s, d):
    return windows.windowed(table(s, d, "events"))


@query("""with last as (select user_id, max_by(event_id, (ts, event_id)) as id, max(ts) as ts from events where user_id is not null and ts is not null and event_id is not null group by 1)
select user_id, id, sha256(id::varchar) as token from last where epoch_ms(ts + interval 12 hours) >= (select max(epoch_ms(ts)) from events where user_id is not null and event_id is not null)""")
def token_life_cycle(s, d):
    """A stream of all events as requests for tokens that live for twelve hours; what is live at its end."""
    path = f"{d}/events.parquet"
    # a stream's source is a folder or a pattern; the table may be one file
    asked = s.readStream.schema(s.read.parquet(path).schema).parquet(f"{path}*")
    asked = asked.select("user_id", F.col("event_id").alias("id"), F.sha2(F.col("event_id").cast("string"), 256).alias("token"), F.col("ts").alias("created_at"), (F.col("ts") + F.expr("interval 12 hours")).alias("expires_at"))
    users = customers(s, d).select(F.col("c_custkey").alias("user_id"), F.concat("c_name", F.lit("@example.org")).alias("address"), F.col("c_name").alias("name"))
    root = f"{shared_folder(s)}/tokens-{uuid.uuid4().hex}"
    tokens.start(asked, users, root).awaitTermination()
    return tokens.live_tokens(tokens.read_finished(s, f"{root}/log", tokens.CHANGES))


@query("select c_custkey, case when c_nationkey = 3 then 'renamed' else c_name end as c_name, c_nationkey from customer where c_nationkey is distinct from 7")
def dml_part(s, d):
    """Customers in key buckets: those of one nation are renamed and those of another deleted, by writes of their buckets alone."""
    rows = customers(s, d).select("c_custkey", "c_name", "c_nationkey")
    path = f"{shared_folder(s)}/customers-{uuid.uuid4().hex}"
    layout.write_buckets(rows, path, "c_custkey", 256)
    renamed, gone = (rows.where(F.col("c_nationkey") == n) for n in (3, 7))
    layout.change_buckets(s, path, "c_custkey", 256, renamed, lambda t: snapshot.update(t, F.col("c_nationkey") == 3, {"c_name": F.lit("renamed")}))
    layout.change_buckets(s, path, "c_custkey", 256, gone, lambda t: snapshot.delete(t, F.col("c_nationkey") == 7))
    return layout.read_buckets(s, path).select(rows.columns)
