"""Registered queries over the driver's tables, each with its DuckDB text where SQL has one.

`@query(views, sql)` registers a function of (spark, sf_dir); `views` names the record views
that the SQL needs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import blocks as K
from ..operators import metrics as M
from ..operators import ordered as O
from ..operators import rules as R
from .views import blk, hdr, obu, pkt, table, turn, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(views: str = "", sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(views, sql) if views else sql
        return f

    return register


def long(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# ---- bytes and bits


@query("", "select doc_id, b0 >> 7 as has_extension, (b0 >> 2) & 31 as type_code, b0 & 3 as temporal_layer, case when b0 >> 7 = 1 then b1 >> 5 else 0 end as embedded_layer, case when b0 >> 7 = 1 then b1 & 31 when (b0 >> 2) & 31 in (2, 20) then 31 else 0 end as extended_layer from (select doc_id, ('0x' || substr(hex(encode(text)), 1, 2))::int as b0, ('0x' || substr(hex(encode(text)), 3, 2))::int as b1 from documents where strlen(text) >= 2)")
def obu_header_bits(spark, sf):
    d = table(spark, sf, "documents").where(F.octet_length("text") >= 2)
    data = F.col("text").cast("binary")
    h = B.obu_header(B.byte_at(data, 0), B.byte_at(data, 1), B.GLOBAL_TYPES)
    h = d.select("doc_id", h.alias("h"))
    return h.select("doc_id", F.col("h.has_extension").cast("int").alias("has_extension"), "h.type_code", "h.temporal_layer", "h.embedded_layer", "h.extended_layer")


_LEB = """select doc_id, v as value, len as length from (
  select doc_id, case when b0 < 128 then b0 when b1 < 128 then (b0 & 127) + (b1 << 7) when b2 < 128 then (b0 & 127) + ((b1 & 127) << 7) + (b2 << 14) when b3 < 128 then (b0 & 127) + ((b1 & 127) << 7) + ((b2 & 127) << 14) + (b3 << 21) end as v,
    case when b0 < 128 then 1 when b1 < 128 then 2 when b2 < 128 then 3 when b3 < 128 then 4 end as len
  from (select doc_id, ('0x' || substr(h, 1, 2))::bigint as b0, ('0x' || substr(h, 3, 2))::bigint as b1, ('0x' || substr(h, 5, 2))::bigint as b2, ('0x' || substr(h, 7, 2))::bigint as b3 from (select doc_id, hex(encode(text)) as h from documents where strlen(text) >= 8)))"""


@query("", _LEB)
def leb128_decode(spark, sf):
    d = table(spark, sf, "documents").where(F.octet_length("text") >= 8)
    n = B.leb128(F.substring(F.col("text").cast("binary"), 1, 8))
    return d.select("doc_id", n.alias("n")).select("doc_id", F.when(F.col("n.length") <= 4, F.col("n.value")).alias("value"), F.when(F.col("n.length") <= 4, F.col("n.length")).alias("length"))


_LEB_ALL = """with d as (select doc_id, hex(encode(substr(text, 1, 8))) as h from documents),
  b as (select doc_id, list_transform(range(8), lambda i: ('0x' || nullif(substr(h, (2 * i + 1)::int, 2), ''))::bigint) as b from d),
  l as (select doc_id, b, nullif(list_position(list_transform(b, lambda x: x < 128), true), 0) as len from b),
  v as (select doc_id, len, list_sum(list_transform(range(len), lambda i: (b[i + 1] & 127) << (7 * i)))::bigint as v from l)
select doc_id, case when v < 4294967296 then v end as value, case when v < 4294967296 then len end as length from v"""


@query("", _LEB_ALL)
def leb128_decode_all(spark, sf):
    """leb128_decode over all texts, however short, and codes of up to 8 bytes; null where there is no code."""
    n = B.leb128(F.substring(F.col("text").cast("binary"), 1, 8))
    return table(spark, sf, "documents").select("doc_id", n.alias("n")).select("doc_id", "n.value", "n.length")


@query("", """select doc_id, case when z >= 0 then (case when z = 0 then 0 else (v >> (15 - 2 * z)) & ((1 << z) - 1) end) + (1 << z) - 1 end as value, case when z >= 0 then 2 * z + 1 end as length from (
  select doc_id, v, case when v >= 32768 then 0 when v >= 16384 then 1 when v >= 8192 then 2 when v >= 4096 then 3 when v >= 2048 then 4 when v >= 1024 then 5 when v >= 512 then 6 when v >= 256 then 7 else -1 end as z
  from (select doc_id, ('0x' || substr(hex(encode(text)), 1, 4))::bigint as v from documents where strlen(text) >= 2))""")
def uvlc_decode(spark, sf):
    d = table(spark, sf, "documents").where(F.octet_length("text") >= 2)
    u = B.uvlc(B.bit_string(F.col("text").cast("binary"), 2))
    return d.select("doc_id", u.alias("u")).select("doc_id", long("u.value").alias("value"), "u.length")


@query("pkt", "select stream, n, case when (bits >> 1) % 16 < 7 then (bits >> 1) % 16 else ((bits >> 1) % 16) * 2 - 7 + bits % 2 end as value from pkt where bits >= 0")
def ns_decode(spark, sf):
    return pkt(spark, sf).where("bits >= 0").select("stream", "n", B.ns(F.col("bits"), 25).alias("value"))


@query("", "select substr(html, 1, 9) as signature, count(*) as n from pages group by 1")
def format_sniff(spark, sf):
    return table(spark, sf, "pages").groupBy(F.substring("html", 1, 9).alias("signature")).agg(F.count("*").alias("n"))


@query("", "select doc_id, (((crc & 255) << 8) | ((crc >> 8) & 255)) & 1023 as field, case when (crc >> 4) & 15 >= 8 then ((crc >> 4) & 15) - 16 else (crc >> 4) & 15 end as signed_field from (select doc_id, ('0x' || substr(md5(text), 1, 4))::bigint as crc from documents)")
def fixed_fields(spark, sf):
    v = F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 4), 16, 10).cast("long")
    d = table(spark, sf, "documents").select("doc_id", v.alias("v"), F.lpad(F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 4), 16, 2), 16, "0").alias("bits"))
    swapped = (F.call_function("shiftleft", F.col("v").bitwiseAND(255), F.lit(8))).bitwiseOR(F.shiftright("v", 8).bitwiseAND(255)).bitwiseAND(1023)
    return d.select("doc_id", swapped.alias("field"), B.signed_bits(F.col("bits"), 8, 4).alias("signed_field"))


# ---- units, roles, limits


@query("obu", "select stream, idx, size, coalesce(sum(size) over (partition by stream order by idx rows between unbounded preceding and 1 preceding), 0)::bigint as byte_offset from obu")
def unit_offsets(spark, sf):
    w = O.before(O.order_within(["stream"], ["idx"]))
    return obu(spark, sf).select("stream", "idx", "size", F.coalesce(F.sum("size").over(w), F.lit(0)).alias("byte_offset"))


@query("obu", "select stream, (row_number() over (partition by stream order by idx) - 1)::int as tile_num, coalesce(sum(size) over (partition by stream order by idx rows between unbounded preceding and 1 preceding), 0)::bigint as tile_offset, size as tile_size from obu where layer = 0")
def tile_framing_explode(spark, sf):
    w = O.order_within(["stream"], ["idx"])
    number, offset = F.row_number().over(w) - 1, F.coalesce(F.sum("size").over(O.before(w)), F.lit(0).cast("long"))
    return obu(spark, sf).where("layer = 0").select("stream", number.alias("tile_num"), offset.alias("tile_offset"), F.col("size").alias("tile_size"))


@query("", "select p_partkey, (p_size + 7) // 8 as n_tiles, list_transform(range(0, p_size, 8), lambda x: x::int)::varchar as starts from part")
def tile_uniform_spacing(spark, sf):
    starts = F.filter(F.sequence(F.lit(0), F.col("p_size"), F.lit(8)), lambda s: s < F.col("p_size"))
    return table(spark, sf, "part").select("p_partkey", F.floor((F.col("p_size") + 7) / 8).cast("int").alias("n_tiles"), F.concat(F.lit("["), F.array_join(starts.cast("array<string>"), ", "), F.lit("]")).alias("starts"))


_ROLE = "case when kind = 'NO' then 'global' when layer = 3 then 'unsupported' when layer = 2 then 'unselected' when kind = 'RF' then 'key_frame' when kind = 'AF' then 'inter_candidate' else 'header' end"


def _role():
    k, layer = F.col("kind"), F.col("layer")
    return F.when(k == "NO", "global").when(layer == 3, "unsupported").when(layer == 2, "unselected").when(k == "RF", "key_frame").when(k == "AF", "inter_candidate").otherwise("header")


@query("obu", f"select {_ROLE} as role, count(*) as n, sum(size)::bigint as bytes from obu group by 1")
def plan_roles(spark, sf):
    return obu(spark, sf).groupBy(_role().alias("role")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("obu", f"select stream, min_by({_ROLE}, idx) as reason, min(idx) as idx from obu where {_ROLE} = 'unsupported' group by 1")
def support_gate(spark, sf):
    return obu(spark, sf).withColumn("role", _role()).where("role = 'unsupported'").groupBy("stream").agg(F.min_by("role", "idx").alias("reason"), F.min("idx").alias("idx"))


@query("obu", "select layer, count(*) as n, sum(size)::bigint as bytes, max(idx) as last_idx from obu where layer in (0, 1) group by 1")
def layer_select(spark, sf):
    return obu(spark, sf).where(F.col("layer").isin(0, 1)).groupBy("layer").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("idx").alias("last_idx"))


_LIMITS = [("unit_size", 60_000), ("quantity", 45), ("units", 6)]


@query("obu", f"select limit_name, count(*) as n, max(actual)::bigint as worst from (select unnest([{{'limit_name': 'unit_size', 'actual': size, 'bound': 60000}}, {{'limit_name': 'quantity', 'actual': qty, 'bound': 45}}, {{'limit_name': 'units', 'actual': idx + 1, 'bound': 6}}], recursive := true) from obu) where actual > bound group by 1")
def resource_limits(spark, sf):
    values = {"unit_size": F.col("size"), "quantity": F.col("qty"), "units": F.col("idx") + 1}
    checks = F.array(*[F.struct(F.lit(n).alias("limit_name"), values[n].alias("actual"), F.lit(b).alias("bound")) for n, b in _LIMITS])
    return obu(spark, sf).select(F.explode(checks).alias("c")).select("c.*").where("actual > bound").groupBy("limit_name").agg(F.count("*").alias("n"), F.max("actual").alias("worst"))


_KINDS = [("AF", "frame", 1), ("NF", "tile_group", 2), ("NO", "temporal_delimiter", 3), ("RF", "key_frame", 4)]


@query("obu", "select coalesce(d.name, 'reserved') as name, count(*) as n from obu left join (values ('AF', 'frame'), ('NF', 'tile_group'), ('NO', 'temporal_delimiter'), ('RF', 'key_frame')) d(kind, name) using (kind) group by 1")
def obu_type_dim(spark, sf):
    dim = spark.createDataFrame(_KINDS, "kind string, name string, code int")
    return obu(spark, sf).join(F.broadcast(dim), "kind", "left").groupBy(F.coalesce("name", F.lit("reserved")).alias("name")).agg(F.count("*").alias("n"))


# ---- order


@query("pkt", "select stream, unit, count(*) as n, sum(bits)::bigint as bits from (select *, sum((event_type = 'signup')::int) over (partition by stream order by n)::bigint as unit from pkt) group by all")
def temporal_units(spark, sf):
    return O.with_session(pkt(spark, sf), ["stream"], ["n"], F.col("event_type") == "signup", "unit").groupBy("stream", "unit").agg(F.count("*").alias("n"), F.sum("bits").alias("bits"))


@query("turn_", "select unit, pos, phase, running_max from (select *, max(phase) over (partition by unit order by pos rows between unbounded preceding and 1 preceding) as running_max from turn_) where phase < running_max")
def unit_order_violations(spark, sf):
    return O.below_running_max(turn(spark, sf), ["unit"], ["pos"], "phase").select("unit", "pos", "phase", "running_max")


@query("pkt", "select stream, n, event_type from (select *, lag(event_type) over (partition by stream order by n) as prev from pkt) where event_type = prev and event_type = 'signup'")
def duplicate_delimiter(spark, sf):
    p = O.with_previous(pkt(spark, sf), ["stream"], ["n"], "event_type", "prev")
    return p.where("event_type = prev and event_type = 'signup'").select("stream", "n", "event_type")


@query("pkt", "select stream, event_type from pkt where n = 0 and event_type <> 'view'")
def missing_first_key(spark, sf):
    return pkt(spark, sf).where("n = 0 and event_type <> 'view'").select("stream", "event_type")


@query("obu", "select stream, idx, layer, running_max from (select *, max(layer) over (partition by stream order by idx rows between unbounded preceding and 1 preceding) as running_max from obu) where layer < running_max")
def layer_ascending(spark, sf):
    return O.below_running_max(obu(spark, sf), ["stream"], ["idx"], "layer").select("stream", "idx", "layer", "running_max")


@query("pkt", "select stream, session, count(*) as n, min(n) as first_n, max(n) as last_n, count(distinct event_type) as kinds from (select *, sum((event_type = 'purchase')::int) over (partition by stream order by n)::bigint as session from pkt) group by all")
def cvs_sessions(spark, sf):
    s = O.with_session(pkt(spark, sf), ["stream"], ["n"], F.col("event_type") == "purchase")
    return s.groupBy("stream", "session").agg(F.count("*").alias("count_n"), F.min("n").alias("first_n"), F.max("n").alias("last_n"), F.count_distinct("event_type").alias("kinds")).withColumnRenamed("count_n", "n")


@query("obu", "select stream, island, any_value(layer) as layer, count(*) as n, sum(size)::bigint as bytes from (select *, sum((ch)::int) over (partition by stream order by idx)::bigint as island from (select *, layer is distinct from lag(layer) over (partition by stream order by idx) as ch from obu)) group by all")
def frame_units(spark, sf):
    return O.islands(obu(spark, sf), ["stream"], ["idx"], "layer").groupBy("stream", "island").agg(F.first("layer").alias("layer"), F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("obu", "select stream, idx, kind, last_value(case when kind = 'RF' then size end ignore nulls) over (partition by stream order by idx rows between unbounded preceding and 1 preceding) as inherited from obu")
def inherited_fields(spark, sf):
    w = O.before(O.order_within(["stream"], ["idx"]))
    return obu(spark, sf).select("stream", "idx", "kind", F.last(F.when(F.col("kind") == "RF", F.col("size")), ignorenulls=True).over(w).alias("inherited"))


# ---- look-ups


@query("hdr", "select a.header_id, a.seen_at, b.profile as active_profile, b.status as active_status from hdr a asof left join hdr b on a.header_id = b.header_id and a.seen_at > b.seen_at")
def header_activation_asof(spark, sf):
    h = hdr(spark, sf)
    return O.as_of(h.select("header_id", "seen_at"), h, "header_id", "seen_at", ["profile", "status"])


@query("", "select doc_id, lang from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def unavailable_reference(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


@query("", "select doc_id, lang from documents d where exists (select 1 from labels l where l.doc_id = d.doc_id)")
def external_hls_semi(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_semi").select("doc_id", "lang")


@query("hdr", "select header_id, count(*) as n, count_if(profile <> first_profile) as mismatches from (select *, first_value(profile) over (partition by header_id order by seen_at) as first_profile from hdr) group by 1")
def header_copy_mismatch(spark, sf):
    first = F.first("profile").over(O.order_within(["header_id"], ["seen_at"]))
    return hdr(spark, sf).withColumn("first_profile", first).groupBy("header_id").agg(F.count("*").alias("n"), F.count_if(F.col("profile") != F.col("first_profile")).alias("mismatches"))


@query("", "select c_nationkey, count(distinct c_mktsegment) as kinds, count(*) as n from customer group by 1 having count(distinct c_mktsegment) > 1")
def scan_type_consistency(spark, sf):
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count_distinct("c_mktsegment").alias("kinds"), F.count("*").alias("n")).where("kinds > 1")


@query("", "select p_brand, count(*) as over_limit, max(p_size) as worst from part join (select p_brand as b, avg(p_size) as ceiling from part group by 1) on b = p_brand and p_size > ceiling group by 1")
def level_limits(spark, sf):
    p = table(spark, sf, "part")
    ceiling = p.groupBy(F.col("p_brand").alias("b")).agg(F.avg("p_size").alias("ceiling"))
    return p.join(ceiling, (F.col("b") == F.col("p_brand")) & (F.col("p_size") > F.col("ceiling"))).groupBy("p_brand").agg(F.count("*").alias("over_limit"), F.max("p_size").alias("worst"))


# ---- rules

_RULES_SQL = """f as (
  select stream, idx, unnest(list_filter([
    case when size > 80000 then {'rule_id': 'unit/size', 'severity': 'error'} end,
    case when qty < 3 then {'rule_id': 'unit/short', 'severity': 'warning'} end,
    case when layer = 3 and kind = 'NO' then {'rule_id': 'unit/layer-scope', 'severity': 'error'} end,
    case when idx >= 6 then {'rule_id': 'stream/long', 'severity': 'info'} end], lambda x: x is not null), recursive := true) from obu)"""


def _rules() -> list[R.Rule]:
    c = F.col
    return [
        R.Rule("unit/size", "error", "unit is larger than a packet may be", c("size") > 80000),
        R.Rule("unit/short", "warning", "unit holds fewer than three parts", c("qty") < 3),
        R.Rule("unit/layer-scope", "error", "a global unit must not name a layer", (c("layer") == 3) & (c("kind") == "NO")),
        R.Rule("stream/long", "info", "stream has more than six units", c("idx") >= 6),
    ]


def _found(spark, sf):
    return R.findings(obu(spark, sf), _rules(), ["stream", "idx"])


def _rule_query(sql: str):
    return query("obu", ", " + _RULES_SQL + "\n" + sql)


@_rule_query("select rule_id, severity, count(*) as n from f group by all")
def rule_engine_report(spark, sf):
    return R.report(_found(spark, sf))


@_rule_query("select count_if(severity = 'error') as errors, count_if(severity = 'warning') as warnings, count_if(severity = 'info') as infos from f")
def severity_summary(spark, sf):
    return R.severity_summary(_found(spark, sf))


@_rule_query("select stream, max(case severity when 'error' then 2 when 'warning' then 1 else 0 end) < 1 as accepted from f group by 1")
def strict_acceptance(spark, sf):
    return R.accepted(_found(spark, sf), "stream", strict=True)


@_rule_query("select stream, idx, rule_id, severity, place, omitted from (select *, row_number() over (partition by stream order by idx, rule_id)::int as place, greatest(0, count(*) over (partition by stream) - 2) as omitted from f) where place <= 2")
def diagnostics_top_n(spark, sf):
    return R.first_findings(_found(spark, sf), "stream", ["idx", "rule_id"], 2)


@_rule_query("select rule_id, side from ((select rule_id, 'missing' as side from (values ('unit/size'), ('unit/never')) e(rule_id) where rule_id not in (select rule_id from f where severity = 'error')) union all (select distinct rule_id, 'unexpected' from f where severity = 'error' and rule_id not in ('unit/size', 'unit/never')))")
def rule_set_equality(spark, sf):
    expected = spark.createDataFrame([("unit/size",), ("unit/never",)], "rule_id string")
    return R.set_difference(_found(spark, sf), expected)


@_rule_query("select rule_id, summary, count(*) as n from f left join (values ('unit/size', 'unit is larger than a packet may be'), ('unit/short', 'unit holds fewer than three parts'), ('unit/layer-scope', 'a global unit must not name a layer'), ('stream/long', 'stream has more than six units')) e(rule_id, summary) using (rule_id) group by all")
def explain_rules(spark, sf):
    return R.explain(_found(spark, sf), _rules()).groupBy("rule_id", "summary").agg(F.count("*").alias("n"))


@_rule_query("select stream, idx, rule_id from f where severity = 'error' group by all")
def finding_dedup(spark, sf):
    return _found(spark, sf).where("severity = 'error'").select("stream", "idx", "rule_id").dropDuplicates()


@query("", "select distinct source from documents where starts_with(source, 'src1')")
def did_you_mean(spark, sf):
    return table(spark, sf, "documents").where(F.col("source").startswith("src1")).select("source").distinct()


# ---- hierarchy and planning


@query("", """with recursive edge as (select n_nationkey as id, n_nationkey // 2 as needs from nation where n_nationkey > 0),
reach(id, needs) as (select n_nationkey, n_nationkey from nation union select r.id, e.needs from reach r join edge e on r.needs = e.id)
select id, count(*) as n, sum(needs)::bigint as s from reach group by 1""")
def layer_closure(spark, sf):
    return spark.sql(
        """with recursive reach(id, needs, depth) as (
        select n_nationkey, n_nationkey, 0 from {nation}
        union all select id, cast(floor(needs / 2) as int), depth + 1 from reach where needs > 0)
      select id, count(*) as n, sum(needs) as s from (select distinct id, needs from reach) group by id""",
        nation=table(spark, sf, "nation"),
    )


@query("pkt", "select stream, n, rank, ref_n, distance from (select a.stream, a.n, b.n as ref_n, a.n - b.n as distance, row_number() over (partition by a.stream, a.n order by abs(a.bits - b.bits), b.n desc)::int as rank from pkt a join pkt b on a.stream = b.stream and b.n < a.n and b.n >= a.n - 16) where rank <= 7")
def ref_ranking(spark, sf):
    p = pkt(spark, sf)
    # the sixteen packets before each come from the window, so nothing is joined
    w = Window.partitionBy("stream").orderBy("n").rowsBetween(-16, -1)
    near = p.withColumn("near", F.collect_list(F.struct("n", "bits")).over(w))
    ranked = F.slice(F.array_sort(F.transform("near", lambda r: F.struct(F.abs(F.col("bits") - r.bits).alias("d"), (-r.n).alias("m")))), 1, 7)
    out = near.select("stream", "n", F.posexplode(ranked).alias("rank", "r"))
    return out.select("stream", "n", (F.col("rank") + 1).alias("rank"), (-F.col("r.m")).alias("ref_n"), (F.col("n") + F.col("r.m")).alias("distance"))


def _place():
    """Position 1..8 in a mini-GOP of eight (display order), 0 for the key frame."""
    return F.when(F.col("n") == 0, 0).otherwise((F.col("n") - 1) % 8 + 1).cast("int")


#: Layer and coding rank of display positions 1..8 of a mini-GOP: the last first, then halves, left before right.
_LAYER = [3, 2, 3, 1, 3, 2, 3, 0]
_RANK = [4, 3, 5, 2, 7, 6, 8, 1]


@query("pkt", f"select stream, n, case when n = 0 then 0 else {_LAYER}[((n - 1) % 8 + 1)::int] end as layer from pkt")
def gop_layers(spark, sf):
    return pkt(spark, sf).select("stream", "n", F.when(F.col("n") == 0, 0).otherwise(F.get(F.array(*map(F.lit, _LAYER)), _place() - 1)).alias("layer"))


def _coding():
    return F.when(F.col("n") == 0, F.lit(0).cast("long")).otherwise(F.floor((F.col("n") - 1) / 8) * 8 + F.get(F.array(*map(F.lit, _RANK)), _place() - 1))


_CODING = f"case when n = 0 then 0 else (n - 1) // 8 * 8 + {_RANK}[((n - 1) % 8 + 1)::int] end"


@query("pkt", f"select stream, n, row_number() over (partition by stream order by {_CODING}) - 1 as coding from pkt")
def gop_coding_order(spark, sf):
    p = pkt(spark, sf).withColumn("key", _coding())
    return p.select("stream", "n", (F.row_number().over(O.order_within(["stream"], ["key"])) - 1).cast("long").alias("coding"))


@query("pkt", f", g as (select stream, n, {_CODING} as key, case when n = 0 or {_LAYER}[((n - 1) % 8 + 1)::int] < 3 then 1 else 0 end as refreshes from pkt) select stream, n, coalesce(sum(refreshes) over (partition by stream order by key rows between unbounded preceding and 1 preceding), 0)::bigint as wave from g")
def gop_waves(spark, sf):
    layer = F.get(F.array(*map(F.lit, _LAYER)), _place() - 1)
    p = pkt(spark, sf).withColumn("key", _coding()).withColumn("refreshes", ((F.col("n") == 0) | (layer < 3)).cast("int"))
    return p.select("stream", "n", F.coalesce(F.sum("refreshes").over(O.before(O.order_within(["stream"], ["key"]))), F.lit(0)).alias("wave"))


@query("pkt", "select stream, session, n, row_number() over (partition by stream, session order by hint, n) - 1 as output from (select *, (bits * 7919) % 64 as hint, sum((event_type = 'signup')::int) over (partition by stream order by n)::bigint as session from pkt)")
def output_reorder(spark, sf):
    s = O.with_session(pkt(spark, sf), ["stream"], ["n"], F.col("event_type") == "signup").withColumn("hint", F.col("bits") * 7919 % 64)
    return s.select("stream", "session", "n", (F.row_number().over(O.order_within(["stream", "session"], ["hint", "n"])) - 1).cast("long").alias("output"))


@query("pkt", "select stream, n, slot, last_n from (select a.stream, a.n, s.slot, (select max(b.n) from pkt b where b.stream = a.stream and b.n < a.n and b.n % 8 = s.slot) as last_n from pkt a, (select unnest(range(8)) as slot) s where a.n % 16 = 15)")
def ref_slot_state(spark, sf):
    at = pkt(spark, sf).where("n % 16 = 15").select("stream", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("slot"))
    # slot s was last written by the largest m < n with m mod 8 = s
    return at.withColumn("last_n", F.col("n") - 1 - F.pmod(F.col("n") - 1 - F.col("slot"), F.lit(8)))


@query("pkt", "select p.stream, p.n, s.slot, max(case when p.n % 8 = s.slot then p.n end) over (partition by p.stream, s.slot order by p.n rows between unbounded preceding and 1 preceding) as last_n from pkt p, (select unnest(range(8)) as slot) s")
def ref_slot_state_all(spark, sf):
    """ref_slot_state at every packet; last_n is null where the slot has no writer yet."""
    at = pkt(spark, sf).select("stream", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("slot"))
    last = F.col("n") - 1 - F.pmod(F.col("n") - 1 - F.col("slot"), F.lit(8))
    return at.withColumn("last_n", F.when(last >= 0, last))


_Q = list(range(16, 256, 16))


@query("pkt", f", w as (select stream, n // 8 as win, sum(bits)::bigint as bits, count(*) as frames from pkt where bits > 0 group by all), q as (select unnest({_Q}) as q) select stream, win, coalesce(min(case when bits * 64 // q <= frames * 6000 then q end), 255)::int as q from w, q group by all")
def rate_vbr_plan(spark, sf):
    w = pkt(spark, sf).where("bits > 0").groupBy("stream", F.floor(F.col("n") / 8).alias("win")).agg(F.sum("bits").alias("bits"), F.count("*").alias("frames"))
    fits = F.filter(F.array(*map(F.lit, _Q)), lambda q: F.floor(F.col("bits") * 64 / q) <= F.col("frames") * 6000)
    return w.select("stream", "win", F.coalesce(F.array_min(fits), F.lit(255)).alias("q"))


@query("pkt", ", l as (select stream, list(bits - 5000 order by n) as v from pkt group by 1) select stream, list_reduce(list_prepend(0::bigint, v), lambda s, x: greatest(-20000, least(20000, s + x)))::bigint as drift from l")
def rate_drift_clamped(spark, sf):
    parts = O.chunks(pkt(spark, sf).withColumn("over", F.col("bits") - 5000), "stream", "n", "over")
    return O.clamped_levels(parts, "stream", -20000, 20000).select("stream", F.col("level").alias("drift"))


@query("pkt", """, w(stream, n, level, overflows) as (
  select stream, -1::bigint, 0::bigint, 0 from pkt group by stream
  union all select p.stream, p.n, greatest(0, least(w.level + p.bits, 15000) - 5000)::bigint, w.overflows + (w.level + p.bits > 15000)::int from w join pkt p on p.stream = w.stream and p.n = w.n + 1)
select stream, max_by(level, n) as level, max(overflows) as overflows from w group by 1""")
def leaky_bucket(spark, sf):
    size, drain = 15000, 5000
    parts = O.chunks(pkt(spark, sf), "stream", "n", "bits")
    # min(level + v, size) - drain, at least 0, is level + (v - drain) clamped to 0 and size - drain
    levels = O.clamped_levels(parts.withColumn("values", F.transform("values", lambda v: v - drain)), "stream", 0, size - drain)
    steps = levels.select("stream", "level", F.explode("steps").alias("step")).select("stream", "level", "step.chunk", "step.before")
    counted = steps.join(parts, ["stream", "chunk"]).select("stream", "level", O.leaky_bucket(F.col("values"), size, drain, F.col("before"))["overflows"].alias("n"))
    return counted.groupBy("stream").agg(F.first("level").alias("level"), F.sum("n").cast("int").alias("overflows"))


@query("pkt", ", l as (select stream, list(bits order by n) as v from pkt group by 1) select stream, list_reduce(v, lambda s, x: (3 * s + x) // 4)::bigint as estimate from l where list_min(v) >= 0")
def drift_model_update(spark, sf):
    folded = O.fold_in_order(pkt(spark, sf), "stream", "n", "bits", lambda s, v: v if s is None else (3 * s + v) // 4)
    return folded.where("least >= 0").select("stream", F.col("state").alias("estimate"))


@query("pkt", "select stream, n, greatest(1, least(255, least(4 * (bits % 64) + 0, 255) + case when n % 8 = 0 then -12 else 8 end))::bigint as qindex from pkt where bits >= 0")
def crf_qindex(spark, sf):
    q = F.least(4 * (F.col("bits") % 64), F.lit(255)) + F.when(F.col("n") % 8 == 0, -12).otherwise(8)
    return pkt(spark, sf).where("bits >= 0").select("stream", "n", B.clip3(1, 255, q).cast("long").alias("qindex"))


@query("pkt", "select stream, n, 1000000 * bits // greatest(1, (sum(bits) over (partition by stream))::bigint) as share from pkt where bits > 0")
def two_pass_budget(spark, sf):
    total = F.sum("bits").over(Window.partitionBy("stream"))
    return pkt(spark, sf).where("bits > 0").withColumn("total", total).select("stream", "n", F.expr("1000000 * bits div greatest(1, total)").alias("share"))


@query("obu", "select stream, min_by(idx, (size + 1000 * qty) * 1000 + idx) as choice, min(size + 1000 * qty) as cost from obu group by 1")
def rd_best_choice(spark, sf):
    cost = F.col("size") + 1000 * F.col("qty")
    return obu(spark, sf).groupBy("stream").agg(F.min_by("idx", F.struct(cost, "idx")).alias("choice"), F.min(cost).alias("cost"))


@query("obu", "select stream, idx, kind, place from (select *, row_number() over (partition by stream, kind order by size, idx)::int as place, row_number() over (partition by stream order by size, idx) as overall, min(size) over (partition by stream) as best from obu) where place <= 2 and (overall = 1 or 16 * size <= best * 24)")
def stage_survivors(spark, sf):
    o = obu(spark, sf)
    ranked = o.withColumn("place", F.row_number().over(O.order_within(["stream", "kind"], ["size", "idx"]))).withColumn("overall", F.row_number().over(O.order_within(["stream"], ["size", "idx"]))).withColumn("best", F.min("size").over(Window.partitionBy("stream")))
    return ranked.where("place <= 2 and (overall = 1 or 16 * size <= best * 24)").select("stream", "idx", "kind", "place")


# ---- blocks


def _to_first(spark, sf):
    """Blocks with `y`: the samples of the block of least id in their segment (one row a segment is carried)."""
    b = blk(spark, sf)
    first = b.groupBy("label").agg(F.min_by("x", "vec_id").alias("y"))
    return b.join(first, "label")


_FIRST = ", fst as (select label, min(vec_id) as fid from blk group by 1), pr as (select a.vec_id, a.label, a.i, a.r, a.c, a.v, b.v as w from px a join fst on fst.label = a.label join px b on b.vec_id = fst.fid and b.i = a.i) "


@query("blk px", _FIRST + "select vec_id, sum(abs(v - w))::bigint as sad from pr group by 1")
def block_sad(spark, sf):
    return _to_first(spark, sf).select("vec_id", K.sad(F.col("x"), F.col("y")).alias("sad"))


@query("blk px", _FIRST + "select vec_id, sse, case when sse = 0 then 'inf' else round(10 * log10(255.0 * 255 * 64 / sse), 6)::varchar end as psnr from (select vec_id, sum((v - w) * (v - w))::bigint as sse from pr group by 1) where sse > 0")
def block_sse_psnr(spark, sf):
    out = _to_first(spark, sf).select("vec_id", K.sse(F.col("x"), F.col("y")).alias("sse")).where("sse > 0")
    return out.select("vec_id", "sse", F.round(K.psnr(F.col("sse"), 64), 6).cast("string").alias("psnr"))


@query("blk px", _FIRST + "select vec_id, round((2 * mx * my + 6.5025) * (2 * (mxy - mx * my) + 58.5225) / ((mx * mx + my * my + 6.5025) * (mxx - mx * mx + myy - my * my + 58.5225)), 6) as ssim from (select vec_id, avg(v)::double as mx, avg(w)::double as my, avg(v * v)::double as mxx, avg(w * w)::double as myy, avg(v * w)::double as mxy from pr group by 1)")
def block_ssim(spark, sf):
    return _to_first(spark, sf).select("vec_id", F.round(K.ssim(F.col("x"), F.col("y")), 6).alias("ssim"))


@query("blk px", _FIRST + "select vec_id, sum(abs(h))::bigint as satd from (select vec_id, k, sum(case when bit_count(k & i) % 2 = 0 then v - w else w - v end) as h from pr, (select unnest(range(64))::int as k) group by all) group by 1")
def block_satd(spark, sf):
    return _to_first(spark, sf).select("vec_id", K.satd(F.col("x"), F.col("y")).alias("satd"))


_M = "m as (select k, j, mm[k * 8 + j + 1] as m from (select " + str([v for row in K.DCT8 for v in row]) + " as mm), (select unnest(range(8))::int as k), (select unnest(range(8))::int as j))"


@query("blk px", f", {_M}, rw as (select vec_id, r, k as c, sum(v * m)::bigint as v from px join m on m.j = px.c group by all) select vec_id, (sum(abs(v)))::bigint as energy, (sum(case when r = 0 and c = 0 then v end))::bigint as dc from (select vec_id, k as r, c, sum(v * m)::bigint as v from rw join m on m.j = rw.r group by all) group by 1")
def block_dct2d(spark, sf):
    out = blk(spark, sf).select("vec_id", K.dct2d(F.col("x")).alias("t"))
    return out.select("vec_id", K.total(F.transform("t", lambda v: F.abs(v))).alias("energy"), K.at(F.col("t"), 0).alias("dc"))


@query("blk px", "select vec_id, sum(sign(v - 128)::bigint * ((abs(v - 128) * 256 + 128 * 12) // (12 * 256)))::bigint as levels, count_if((abs(v - 128) * 256 + 128 * 12) // (12 * 256) > 0) as nonzero from px group by 1")
def block_quantize(spark, sf):
    levels = K.quantized(F.transform("x", lambda v: v - 128), 12)
    out = blk(spark, sf).select("vec_id", levels.alias("q"))
    return out.select("vec_id", K.total(F.col("q")).alias("levels"), F.size(F.filter("q", lambda v: v != 0)).cast("long").alias("nonzero"))


@query("blk px", "select vec_id, sum(abs(greatest(-400, least(399, (v - 128) * 12))))::bigint as magnitude from px group by 1")
def block_dequant(spark, sf):
    r = F.transform(F.transform("x", lambda v: (v - 128) * 12), lambda v: B.clip3(-400, 399, v))
    return blk(spark, sf).select("vec_id", K.total(F.transform(r, lambda v: F.abs(v))).alias("magnitude"))


@query("", "select q, (floor(8.0::double * pow(2.0::double, ((q - 1) % 24) / 24.0::double) + 0.5::double)::bigint << ((q - 1) // 24)::int)::bigint as step from (select unnest(range(1, 304)) as q)")
def quantizer_table(spark, sf):
    return spark.range(1, 304).select(F.col("id").alias("q"), K.quantizer_step(F.col("id")).alias("step"))


@query("blk px", _FIRST + "select vec_id, sum(greatest(0, least(255, v + w - 128)))::bigint as total from pr group by 1")
def residual_add_clip(spark, sf):
    out = K.residual_added(F.col("x"), F.transform("y", lambda v: v - 128))
    return _to_first(spark, sf).select("vec_id", K.total(out).alias("total"))


@query("", "select row_number() over (order by r + c, r) - 1 as scan, r * 8 + c as pos from (select unnest(range(8)) as r), (select unnest(range(8)) as c)")
def scan_order_diag(spark, sf):
    cells = spark.range(64).select(F.col("id").alias("pos"), F.floor(F.col("id") / 8).alias("r"), (F.col("id") % 8).alias("c"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("r") + F.col("c"), "r")  # 64 rows
    return cells.select((F.row_number().over(w) - 1).cast("long").alias("scan"), "pos")


@query("blk px", "select vec_id, (sum(case when r = 0 then v else 0 end) + sum(case when c = 0 then v else 0 end) + 8)::bigint >> 4 as dc from px group by 1")
def intra_dc(spark, sf):
    above, left = F.slice("x", 1, 8), F.transform(K.indexes(8), lambda i: K.at(F.col("x"), i * 8))
    return blk(spark, sf).select("vec_id", B.round2(K.total(above) + K.total(left), 4).alias("dc"))


_EDGES = ", e as (select a.vec_id, a.i, a.r, a.c, a.v, t.v as above, l.v as lft, o.v as corner from px a join px t on t.vec_id = a.vec_id and t.r = 0 and t.c = a.c join px l on l.vec_id = a.vec_id and l.c = 0 and l.r = a.r join px o on o.vec_id = a.vec_id and o.i = 0) "


def _cells(f):
    """Sum over cells of f(above, left, corner, row, column)."""
    x = F.col("x")
    return K.total(F.transform(K.indexes(), lambda i: f(K.at(x, i % 8), K.at(x, F.floor(i / 8).cast("int") * 8), K.at(x, 0), F.floor(i / 8).cast("int"), i % 8)))


@query("blk px", _EDGES + "select vec_id, sum(case when abs(above - corner) <= abs(lft - corner) and abs(above - corner) <= abs(above + lft - 2 * corner) then lft when abs(lft - corner) <= abs(above + lft - 2 * corner) then above else corner end)::bigint as predicted from e group by 1")
def intra_paeth(spark, sf):
    return blk(spark, sf).select("vec_id", _cells(lambda a, le, o, r, c: K.paeth(a, le, o)).alias("predicted"))


@query("blk px", _EDGES + "select vec_id, sum((above * (8 - r) + lft * (8 - c) + corner * (r + c) + 8) >> 4)::bigint as predicted from e group by 1")
def intra_smooth(spark, sf):
    return blk(spark, sf).select("vec_id", _cells(lambda a, le, o, r, c: B.round2(a * (8 - r) + le * (8 - c) + o * (r + c), 4)).alias("predicted"))


@query("blk px", _EDGES + "select vec_id, sum(above)::bigint as vertical, sum(lft)::bigint as horizontal from e group by 1")
def intra_cardinal(spark, sf):
    return blk(spark, sf).select("vec_id", _cells(lambda a, le, o, r, c: a).alias("vertical"), _cells(lambda a, le, o, r, c: le).alias("horizontal"))


@query("blk px", ", f as (select vec_id, c, (2 * v + 4 * lag(v, 1, v) over w + 4 * v + 4 * lead(v, 1, v) over w + 2 * v + 8) >> 4 as s from px where r = 0 window w as (partition by vec_id order by c)) select vec_id, sum(s)::bigint as smoothed from f group by 1")
def edge_filter(spark, sf):
    x, last = F.col("x"), 7
    s = F.transform(K.indexes(8), lambda i: B.round2(8 * K.at(x, i) + 4 * K.at(x, F.greatest(F.lit(0), i - 1)) + 4 * K.at(x, F.least(F.lit(last), i + 1)), 4))
    return blk(spark, sf).select("vec_id", K.total(s).alias("smoothed"))


_PALETTE = [64, 112, 128, 144, 192]


@query("blk px", f", p as (select k, {_PALETTE}[k + 1] as pv from (select unnest(range(5))::int as k)) select vec_id, sum(k)::bigint as indexes, sum(d)::bigint as distance from (select vec_id, i, min(abs(v - pv) * 8 + k) % 8 as k, min(abs(v - pv)) as d from px, p group by all) group by 1")
def palette_index(spark, sf):
    palette = F.array(*map(F.lit, _PALETTE))
    best = F.transform("x", lambda v: F.array_min(F.transform(palette, lambda p, k: F.abs(v - p) * 8 + k)))
    out = blk(spark, sf).select("vec_id", best.alias("b"))
    return out.select("vec_id", K.total(F.transform("b", lambda v: v % 8)).alias("indexes"), K.total(F.transform("b", lambda v: F.shiftright(v, 3))).alias("distance"))


@query("blk", "select vec_id, least(len(list_distinct(x)), 17)::int as colours, (list_max(x) - list_min(x))::int as span from blk")
def distinct_colours(spark, sf):
    return blk(spark, sf).select("vec_id", F.least(F.size(F.array_distinct("x")), F.lit(17)).alias("colours"), (F.array_max("x") - F.array_min("x")).alias("span"))


@query("blk", "select label, count_if(list_max(x) - list_min(x) > 16) as textured, count_if(list_max(x) - list_min(x) > 16 and len(list_distinct(x)) <= 40) as few, count_if(list_max(x) - list_min(x) > 16 and len(list_distinct(x)) <= 40) * 64 >= 6 * count_if(list_max(x) - list_min(x) > 16) as screen from blk group by 1 having count_if(list_max(x) - list_min(x) > 16) > 0")
def screen_content_share(spark, sf):
    span, few = F.array_max("x") - F.array_min("x") > 16, F.size(F.array_distinct("x")) <= 40
    out = blk(spark, sf).groupBy("label").agg(F.count_if(span).alias("textured"), F.count_if(span & few).alias("few")).where("textured > 0")
    return out.withColumn("screen", F.col("few") * 64 >= 6 * F.col("textured"))


@query("blk px", _FIRST + ", s as (select vec_id, 64::bigint as n, sum(w)::bigint as l, sum(v)::bigint as cc, sum(w * w)::bigint as ll, sum(v * w)::bigint as lc, sum(v * v)::bigint as c2 from pr group by 1) select vec_id, greatest(0, n * c2 - cc * cc - case when n * ll - l * l = 0 then 0 else (n * lc - l * cc) * (n * lc - l * cc) // (n * ll - l * l) end)::bigint as residual from s")
def cfl_linear_fit(spark, sf):
    x, y = F.col("x"), F.col("y")
    sums = _to_first(spark, sf).select("vec_id", K.total(y).alias("l"), K.total(x).alias("c"), K.total(F.transform(y, lambda v: v * v)).alias("ll"), K.total(F.zip_with(x, y, lambda a, b: a * b)).alias("lc"), K.total(F.transform(x, lambda v: v * v)).alias("cc"))
    return sums.select("vec_id", F.expr("greatest(0, 64 * cc - c * c - case when 64 * ll - l * l = 0 then 0 else (64 * lc - l * c) * (64 * lc - l * c) div (64 * ll - l * l) end)").alias("residual"))


@query("blk px", _FIRST + "select vec_id, sum((v + w + 1) >> 1)::bigint as blended from pr group by 1")
def compound_average(spark, sf):
    return _to_first(spark, sf).select("vec_id", K.total(F.zip_with("x", "y", lambda a, b: B.round2(a + b, 1))).alias("blended"))


@query("blk px", _FIRST + "select vec_id, sum((v * (8 * c + 4) + w * (64 - 8 * c - 4) + 32) >> 6)::bigint as blended from pr group by 1")
def mask_blend(spark, sf):
    x, y = F.col("x"), F.col("y")
    cell = F.transform(K.indexes(), lambda i: B.round2(K.at(x, i) * (8 * (i % 8) + 4) + K.at(y, i) * (60 - 8 * (i % 8)), 6))
    return _to_first(spark, sf).select("vec_id", K.total(cell).alias("blended"))


#: Line number of cell (r, c) in eight directions, as text for both engines.
_DIRECTIONS = ["r + c", "r + c // 2", "r", "3 + r - c // 2", "7 + r - c", "3 - r // 2 + c", "c", "r // 2 + c"]


def _direction_lines() -> list[list[list[int]]]:
    """For each direction the cells of each line; the terms of _DIRECTIONS are Python, too."""
    out = []
    for line in _DIRECTIONS:
        lines: dict[int, list[int]] = {}
        for i in range(64):
            lines.setdefault(eval(line, {"r": i // 8, "c": i % 8}), []).append(i)
        out.append(list(lines.values()))
    return out


@query("blk px", ", d as (" + " union all ".join(f"select vec_id, {k} as dir, {e} as line, sum(v - 128)::bigint as s, count(*) as n from px group by vec_id, {e}" for k, e in enumerate(_DIRECTIONS)) + "), e as (select vec_id, dir, sum(s * s * (840 // n))::bigint as cost from d group by all), b as (select vec_id, max(cost) as best, min_by(dir, -cost * 8 + dir) as dir from e group by 1) select b.vec_id, b.dir, (b.best - e.cost) >> 10 as variance from b join e on e.vec_id = b.vec_id and e.dir = (b.dir + 4) % 8")
def cdef_direction(spark, sf):
    x = F.col("x")
    sums = [F.transform(F.array(*[F.array(*map(F.lit, cells)) for cells in lines]), lambda c: F.struct(K.total(F.transform(c, lambda i: F.get(x, i) - 128)).alias("s"), F.size(c).alias("n"))) for lines in _direction_lines()]
    costs = F.array(*[K.total(F.transform(s, lambda t: t["s"] * t["s"] * F.floor(F.lit(840) / t["n"]))) for s in sums])
    best = blk(spark, sf).select("vec_id", costs.alias("costs")).withColumn("dir", (F.array_position("costs", F.array_max("costs")) - 1).cast("int"))
    return best.select("vec_id", "dir", F.shiftright(F.array_max("costs") - F.get("costs", (F.col("dir") + 4) % 8), 10).alias("variance"))


@query("blk px", ", d as (select vec_id, v - lag(v) over (partition by vec_id, r order by c) as d from px) select vec_id, sum(sign(d)::bigint * least(abs(d), greatest(0, 16 - (abs(d) >> 1))))::bigint as constrained from d where d is not null group by 1")
def cdef_constrain(spark, sf):
    x = F.col("x")
    d = F.transform(F.filter(K.indexes(), lambda i: i % 8 > 0), lambda i: K.constrained(K.at(x, i) - K.at(x, i - 1), 16, 5))
    return blk(spark, sf).select("vec_id", K.total(d).alias("constrained"))


@query("blk px", ", t as (select vec_id, r, max(case when c = 2 then v end) as p1, max(case when c = 3 then v end) as p0, max(case when c = 4 then v end) as q0, max(case when c = 5 then v end) as q1 from px group by all), d as (select vec_id, greatest(-24, least(24, 4 * (p1 - q1 + 3 * (q0 - p0)))) as d, p0, q0 from t) select vec_id, sum(greatest(0, least(255, p0 + ((d + 8) >> 4))))::bigint as p_side, sum(greatest(0, least(255, q0 - ((d + 8) >> 4))))::bigint as q_side from d group by 1")
def deblock_edge(spark, sf):
    x = F.col("x")

    def side(sign: int):
        def row(r):
            p1, p0, q0, q1 = (K.at(x, r * 8 + c) for c in (2, 3, 4, 5))
            d = B.round2(B.clip3(-24, 24, 4 * (p1 - q1 + 3 * (q0 - p0))), 4)
            return B.clip3(0, 255, p0 + d if sign > 0 else q0 - d)

        return K.total(F.transform(K.indexes(8), row))

    return blk(spark, sf).select("vec_id", side(1).alias("p_side"), side(-1).alias("q_side"))


@query("blk px", _FIRST + "select label, v >> 5 as band, sign(v - w)::int as class, sum(v - w)::bigint as diff, count(*) as n from pr group by all")
def ccso_class_stats(spark, sf):
    cells = _to_first(spark, sf).select("label", F.explode(F.arrays_zip("x", "y")).alias("p"))
    d = F.col("p.x") - F.col("p.y")
    return cells.groupBy("label", F.shiftright("p.x", 5).alias("band"), F.signum(d).cast("int").alias("class")).agg(F.sum(d).alias("diff"), F.count("*").alias("n"))


@query("blk px", ", t as (select label, v as x0, lag(v) over (partition by vec_id, r order by c) as x1, lead(v) over (partition by vec_id, r order by c) as x2 from px) select label, sum(x0 * x0)::bigint as m00, sum(x0 * (x1 + x2))::bigint as m01, sum((x1 + x2) * (x1 + x2))::bigint as m11, count(*) as n from t where x1 is not null and x2 is not null group by 1")
def wiener_moments(spark, sf):
    x = F.col("x")
    inner = F.transform(F.filter(K.indexes(), lambda i: (i % 8 > 0) & (i % 8 < 7)), lambda i: F.struct(K.at(x, i).alias("a"), (K.at(x, i - 1) + K.at(x, i + 1)).alias("b")))
    cells = blk(spark, sf).select("label", F.explode(inner).alias("p"))
    a, b = F.col("p.a"), F.col("p.b")
    return cells.groupBy("label").agg(F.sum(a * a).alias("m00"), F.sum(a * b).alias("m01"), F.sum(b * b).alias("m11"), F.count("*").alias("n"))


@query("blk px", ", f as (select vec_id, r // 2 as br, c // 2 as bc, max(v) - min(v) as d2 from px group by all), g as (select vec_id, br // 2 as br, bc // 2 as bc, sum(d2) + 12 as split from f group by all), h as (select vec_id, r // 4 as br, c // 4 as bc, 2 * (max(v) - min(v)) as leaf from px group by all), l as (select g.vec_id, sum(least(split, leaf)) + 12 as split from g join h on g.vec_id = h.vec_id and g.br = h.br and g.bc = h.bc group by 1), t as (select vec_id, 4 * (max(v) - min(v)) as leaf from px group by 1) select vec_id, least(split, leaf)::bigint as cost, leaf <= split as whole from l join t using (vec_id)")
def partition_quadtree(spark, sf):
    x = F.col("x")

    def span(r: int, c: int, n: int):
        cells = F.array(*[K.at(x, (r + i) * 8 + c + j) for i in range(n) for j in range(n)])
        return F.array_max(cells) - F.array_min(cells)

    def cost(r: int, c: int, n: int):
        if n == 2:
            return span(r, c, 2)
        h = n // 2
        split = sum((cost(r + i, c + j, h) for i in (0, h) for j in (0, h)), F.lit(12))
        return F.least(split, n // 2 * span(r, c, n)) if n < 8 else split

    out = blk(spark, sf).select("vec_id", cost(0, 0, 8).alias("split"), (4 * span(0, 0, 8)).alias("leaf"))
    return out.select("vec_id", F.least("split", "leaf").cast("long").alias("cost"), (F.col("leaf") <= F.col("split")).alias("whole"))


# ---- hashes, histograms, reports


@query("", "with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents) select md5(line) as hash, min(doc_id) as first_doc, count(distinct doc_id) as docs, count(*) as n from l group by 1 having count(*) > 1")
def row_hash_match(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy(F.md5(F.col("line").cast("binary")).alias("hash")).agg(F.min("doc_id").alias("first_doc"), F.count_distinct("doc_id").alias("docs"), F.count("*").alias("n")).where("n > 1")


@query("", "select doc_id, sha256(lang || ':' || coalesce(source, '') || ':' || text) as digest, strlen(text)::bigint as visible_bytes from documents")
def frame_hash(spark, sf):
    whole = F.concat("lang", F.lit(":"), F.coalesce("source", F.lit("")), F.lit(":"), "text")
    return table(spark, sf, "documents").select("doc_id", F.sha2(whole.cast("binary"), 256).alias("digest"), F.octet_length("text").cast("long").alias("visible_bytes"))


@query("pkt", ", l as (select stream, list(event_type = 'click' order by n) as v from pkt group by 1) select stream, list_reduce(list_prepend(16384::bigint, list_transform(v, lambda b: b::bigint)), lambda p, b: case when b = 1 then p + ((32768 - p) >> 5) else p - (p >> 5) end)::bigint as p from l")
def cdf_adapt_fold(spark, sf):
    hits = pkt(spark, sf).withColumn("hit", (F.col("event_type") == "click").cast("long"))
    folded = O.fold_in_order(hits, "stream", "n", "hit", lambda p, b: p + ((32768 - p) >> 5) if b else p - (p >> 5), 16384)
    return folded.select("stream", F.col("state").alias("p"))


@query("pkt", ", c as (select stream, event_type, count(*) as n from pkt group by all), t as (select stream, sum(n) as t from c group by 1) select stream, round(sum(-n * log2(n::double / t)), 6) as bits, any_value(t)::bigint as symbols from c join t using (stream) group by 1")
def symbol_cost_entropy(spark, sf):
    c = pkt(spark, sf).groupBy("stream", "event_type").agg(F.count("*").alias("n"))
    c = c.withColumn("t", F.sum("n").over(Window.partitionBy("stream")))
    return c.groupBy("stream").agg(F.round(F.sum(-F.col("n") * F.log2(F.col("n") / F.col("t"))), 6).alias("bits"), F.first("t").alias("symbols"))


@query("", "select lang, band, sum(n >> 2)::bigint as mean_quarter, count(*) as tiles from (select lang, source, n_chars // 1000 as band, count(*) * 16 as n from documents group by all) group by all")
def cdf_average(spark, sf):
    tiles = table(spark, sf, "documents").groupBy("lang", "source", F.floor(F.col("n_chars") / 1000).alias("band")).agg((F.count("*") * 16).alias("n"))
    return tiles.groupBy("lang", "band").agg(F.sum(F.shiftright("n", 2)).alias("mean_quarter"), F.count("*").alias("tiles"))


def _byte_counts(docs: DataFrame, *keys: str) -> DataFrame:
    """(*keys, byte, n) over the whole UTF-8 texts of docs; a text is counted where it is read, so at most 256 rows of it travel."""
    import pyarrow as pa

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                text = part.column(part.num_columns - 1)
                counts = [np.bincount(np.frombuffer(t, np.uint8), minlength=256) for t in text.to_pylist()]
                counts = np.array(counts, np.int64).reshape(-1, 256)
                who, byte = np.nonzero(counts)
                own = [part.column(i).take(pa.array(who)) for i in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(byte.astype(np.int32)), pa.array(counts[who, byte])], names=[*keys, "byte", "n"])

    rows = docs.where(F.col("text").isNotNull()).select(*keys, F.col("text").cast("binary").alias("text"))
    types = dict(rows.dtypes)
    found = rows.mapInArrow(counted, ", ".join(f"{k} {types[k]}" for k in keys) + ", byte int, n long")
    return found.groupBy(*keys, "byte").agg(F.sum("n").alias("n"))


_BYTES = "unnest(regexp_extract_all(hex(encode(text)), '..')) as h from documents"


@query("", f"with c as (select doc_id, h, count(*) as n from (select doc_id, {_BYTES}) group by all), t as (select doc_id, n, sum(n) over (partition by doc_id) as t from c) select doc_id, round(sum(-n * log2(n::double / t)) / any_value(t), 6) as bits_per_byte, any_value(t)::bigint as n_bytes from t group by 1")
def symbol_cost_entropy_bytes(spark, sf):
    """Order-0 entropy of each document's bytes, in bits per byte; a text without bytes has no row."""
    c = _byte_counts(table(spark, sf, "documents"), "doc_id")
    c = c.withColumn("t", F.sum("n").over(Window.partitionBy("doc_id")))
    return c.groupBy("doc_id").agg(F.round(F.sum(-F.col("n") * F.log2(F.col("n") / F.col("t"))) / F.first("t"), 6).alias("bits_per_byte"), F.first("t").alias("n_bytes"))


@query("", f"select lang, ('0x' || h)::int as byte, sum(n >> 3)::bigint as mean, sum(n)::bigint as n from (select lang, tile, h, count(*) as n from (select lang, doc_id % 8 as tile, {_BYTES}) group by all) group by all")
def cdf_average_bytes(spark, sf):
    """Byte histograms of eight tiles of each language (doc_id mod 8), averaged with each term shifted before the sum."""
    d = table(spark, sf, "documents").withColumn("tile", F.col("doc_id") % 8)
    return _byte_counts(d, "lang", "tile").groupBy("lang", "byte").agg(F.sum(F.shiftright("n", 3)).alias("mean"), F.sum("n").alias("n"))


@query("obu", "select stream, sum(size)::bigint as bytes, count(*) as n, (min(size) * 100 // max(size))::bigint as spread from obu group by rollup(stream)")
def perf_rollup(spark, sf):
    return obu(spark, sf).rollup("stream").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.expr("min(size) * 100 div max(size)").alias("spread"))


@query("pkt", "select stream, n, sum(bits) over (partition by stream order by n rows between current row and 7 following)::bigint as ahead from pkt")
def lookahead_window(spark, sf):
    return pkt(spark, sf).select("stream", "n", F.sum("bits").over(O.order_within(["stream"], ["n"]).rowsBetween(0, 7)).alias("ahead"))


@query("pkt", ", r as (select stream, n, 100 * least(bits, prev) // greatest(1, bits) as ratio from (select *, lag(bits) over (partition by stream order by n) as prev from pkt where bits > 0) where prev is not null) select stream, n, ratio from (select *, lag(ratio, 1, 0) over (partition by stream order by n) as before from r) where ratio >= 70 and ratio >= before + 20")
def lookahead_scene_cut(spark, sf):
    w = O.order_within(["stream"], ["n"])
    r = pkt(spark, sf).where("bits > 0").withColumn("prev", F.lag("bits").over(w)).where("prev is not null").withColumn("ratio", F.expr("100 * least(bits, prev) div greatest(1, bits)"))
    return r.withColumn("before", F.lag("ratio", 1, 0).over(w)).where("ratio >= 70 and ratio >= before + 20").select("stream", "n", "ratio")


@query("pkt", "select a.stream, a.n, (a.bits + coalesce(b.bits, 0)) * (a.bits - least(a.bits, coalesce(b.bits, 0) // 2 + 16)) // greatest(a.bits, 1) as passed from pkt a left join pkt b on b.stream = a.stream and b.n = a.n + 1 where a.bits >= 0 and coalesce(b.bits, 0) >= 0")
def tpl_two_level(spark, sf):
    p = pkt(spark, sf).withColumn("after", F.coalesce(F.lead("bits").over(O.order_within(["stream"], ["n"])), F.lit(0)))
    return p.where("bits >= 0 and after >= 0").select("stream", "n", F.expr("(bits + after) * (bits - least(bits, after div 2 + 16)) div greatest(bits, 1)").alias("passed"))


@query("pkt", "select stream, n, (coalesce(lag(bits, 2) over w, bits) + 4 * coalesce(lag(bits) over w, bits) + 6 * bits + 4 * coalesce(lead(bits) over w, bits) + coalesce(lead(bits, 2) over w, bits) + 8) >> 4 as filtered from pkt window w as (partition by stream order by n)")
def temporal_filter_mean(spark, sf):
    w, own = O.order_within(["stream"], ["n"]), F.col("bits")
    tap = lambda k: F.coalesce(F.lag("bits", -k).over(w), own)
    return pkt(spark, sf).select("stream", "n", B.round2(tap(-2) + 4 * tap(-1) + 6 * own + 4 * tap(1) + tap(2), 4).alias("filtered"))


@query("", "select event_id, json_extract(props, '$.k')::bigint as k from events")
def inspect_json_fields(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("turn_", "select phase, side from ((select phase, 'both' as side from turn_ where pos = 0 intersect select phase, 'both' from turn_ where pos = 1) union all (select phase, 'first_only' from (select phase from turn_ where pos = 0 except select phase from turn_ where pos = 1)))")
def set_ops_roles(spark, sf):
    t = turn(spark, sf)
    first, second = t.where("pos = 0").select("phase"), t.where("pos = 1").select("phase")
    return first.intersect(second).withColumn("side", F.lit("both")).unionByName(first.subtract(second).withColumn("side", F.lit("first_only")))




@query("obu", "select kind, count(*) as n, sum(qty)::bigint as p1, sum(qty * qty)::bigint as p2, sum(qty * qty * qty)::bigint as p3, sum(qty * size)::bigint as xy, sum(qty * qty * size)::bigint as xxy from obu group by 1")
def cubic_moments(spark, sf):
    q, s = F.col("qty"), F.col("size")
    return obu(spark, sf).groupBy("kind").agg(F.count("*").alias("n"), F.sum(q).alias("p1"), F.sum(q * q).alias("p2"), F.sum(q * q * q).alias("p3"), F.sum(q * s).alias("xy"), F.sum(q * q * s).alias("xxy"))


def _bd_rate_sql() -> str:
    stages, body = [], "sums"
    for k, stage in enumerate(M.elimination()):
        stages.append(f"e{k} as (select *, {', '.join(f'{e} as {n}' for n, e in stage.items())} from {body})")
        body = f"e{k}"
    sums = ", ".join(f"{e} as {n}" for n, e in M.moments("t", "log_rate").items())
    return f""", p as (select layer, kind as curve, avg(size) as rate, 30.0::double + floor(qty / 5) as quality from obu where kind in ('AF', 'RF') group by layer, kind, floor(qty / 5)
), g as (select layer, greatest(min(case curve when 'AF' then quality end), min(case curve when 'RF' then quality end)) as low, least(max(case curve when 'AF' then quality end), max(case curve when 'RF' then quality end)) as high,
    (max(quality) + min(quality)) / 2 as middle, greatest((max(quality) - min(quality)) / 2, 1e-9) as half, count(distinct curve) as curves from p group by layer
), s as (select p.layer, curve, (quality - middle) / half as t, ln(rate) as log_rate from p join g using (layer)
), sums as (select layer, curve, count(distinct t) as different, {sums} from s group by layer, curve), {", ".join(stages)}
, m as (select layer, curve, low, high, curves, case when different >= 4 then {M.MEAN} end as mean from (select *, (low - middle) / half as a, (high - middle) / half as b from {body} join g using (layer)))
select layer, case when max(curves) = 2 and max(high) > max(low) then round((exp(max(case curve when 'RF' then mean end) - max(case curve when 'AF' then mean end)) - 1) * 100, 6) end as bd_rate from m group by layer"""


@query("obu", _bd_rate_sql())
def bd_rate(spark, sf):
    """One curve for each kind of unit in a layer, a point for each quality step."""
    step = F.floor(F.col("qty") / 5)
    points = obu(spark, sf).groupBy("layer", F.col("kind").alias("curve"), step.alias("step")).agg(F.avg("size").alias("rate"))
    return M.bd_rate(points.withColumn("quality", 30.0 + F.col("step")), "layer", "AF", "RF").withColumn("bd_rate", F.round("bd_rate", 6))
