"""Queries of ordered machines, deferred and versioned checks, reference order, palettes, fits and the unit source."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import blocks as K
from ..operators import gop
from ..operators import graphs as G
from ..operators import metrics as M
from ..operators import replay as P
from ..sources import datasource as D
from ..streaming import machines as S
from .catalogue import query
from .views import blk, obu, pkt, table

# ---- ordered machines over whole streams


@query()
def output_schedule(spark, sf):
    """Frames in the order in which a decoder shows them; no SQL, as slots hold state (tests: another implementation)."""
    bits = lambda at, n: F.shiftright("bits", at).bitwiseAND((1 << n) - 1)
    slot = lambda k: F.call_function("shiftleft", F.lit(1), k.cast("int"))
    kinds = F.array(*map(F.lit, (4, 5, 6, 7, 7, 10, 12, 7)))
    frames = pkt(spark, sf).select(
        "stream",
        "n",
        (F.col("n") + bits(0, 3) - 3).alias("hint"),
        F.get(kinds, bits(3, 3).cast("int")).alias("kind"),
        (bits(6, 1) == 1).alias("first"),
        (bits(7, 1) == 1).alias("immediate"),
        (bits(7, 1) == 0).alias("implicit"),
        slot((F.col("event_id") % 8)).bitwiseOR(slot(bits(8, 3))).alias("mask"),
        (bits(3, 3) < 2).alias("key"),
    )
    return S.run_batch(frames, S.OutputSchedule)


@query("pkt", ", u as (select *, sum((event_type = 'signup')::int) over (partition by stream order by n) as unit from pkt) select stream, unit::bigint as unit, min(n) as first_n, count(*) as rows, sum(bits)::bigint as bits from u group by stream, unit")
def unit_totals_to_the_end(spark, sf):
    """Units with the last one of each stream."""
    return S.run_batch(pkt(spark, sf).withColumn("opens", F.col("event_type") == "signup"), S.UnitTotals)


_KINDS = {"signup": 2, "view": 4, "click": 7, "error": 1, "purchase": 9}


ORDERED_SQL = f"""with k as (select stream, n, case event_type {' '.join(f"when '{e}' then {c}" for e, c in _KINDS.items())} end as kind, bits % 4 as phase, bits % 3 as layer from pkt
), u as (select *, sum((kind = 2)::int) over (partition by stream order by n) as unit, lag(kind) over (partition by stream order by n) as before, lead(kind) over (partition by stream order by n) as behind from k
), w as (select *, max(case when kind <> 2 then phase end) over (partition by stream, unit order by n rows between unbounded preceding and 1 preceding) as top, case when before <> 2 then lag(layer) over (partition by stream, unit order by n) end as below,
    count(*) filter (kind in (4, 5, 6, 7, 10, 11, 12, 13, 14, 19, 21)) over (partition by stream, unit) as frames from u)
select stream, n, 'unit/duplicate-delimiter' as rule_id, 'error' as severity from w where kind = 2 and before = 2
union all select stream, n, 'unit/missing-delimiter', 'error' from w where n = 0 and kind <> 2
union all select stream, n, 'unit/phase-order', 'error' from w where kind <> 2 and phase < top
union all select stream, n, 'unit/layer-order', 'warning' from w where kind <> 2 and layer < below
union all select stream, n, 'unit/no-frame', 'warning' from w where kind = 2 and frames = 0 and behind is distinct from 2"""


@query("pkt", f"select * from ({ORDERED_SQL})")
def ordered_findings(spark, sf):
    """Findings about order; that a unit has no frame is known at its end and reported at its beginning."""
    kind = F.lit(None)
    for name, code in _KINDS.items():
        kind = F.when(F.col("event_type") == name, code).otherwise(kind)
    return S.run_batch(pkt(spark, sf).select("stream", "n", kind.cast("int").alias("kind"), (F.col("bits") % 4).cast("int").alias("phase"), (F.col("bits") % 3).cast("int").alias("layer")), S.OrderChecks)


@query(
    "pkt",
    """, c as (select stream, n from pkt where event_type = 'signup'
), a(stream, origin) as (
  select distinct stream, 0::bigint from pkt
  union all select stream, nxt from (select a.stream, (select min(c.n) from c where c.stream = a.stream and c.n > a.origin and (c.n - a.origin) % 30 >= 8) as nxt from a) where nxt is not null
), k as (select stream, n, (n - (select max(origin) from a where a.stream = p.stream and origin <= p.n)) % 30 = 0 as is_key from pkt p
), w as (select *, max(case when is_key then n end) over (partition by stream order by n) as key, min(case when is_key then n end) over (partition by stream order by n rows between 1 following and unbounded following) as nxt, max(n) over (partition by stream) + 1 as e from k
), b as (select *, case when is_key then n else key + 1 + (n - key - 1) // 8 * 8 end as first from w
), l as (select *, least(8, coalesce(nxt, e) - first) as size, n - first + 1 as place from b
), h(size, kind, low, high, layer, path) as (
  select s, 'group', 0, s::int, 0, '' from range(1, 9) r(s)
  union all select size, case when half = 0 then 'group' else 'between' end, case when kind = 'group' or half = 0 then low else low + (high - low) // 2 end, case when kind = 'between' and half = 0 then low + (high - low) // 2 else high end,
    case when kind = 'group' then layer + 1 else layer end, path || half::varchar
  from h, range(0, 2) t(half) where high - low > 1 and (kind = 'between' or half = 1)
), o as (select size, high as place, layer, high - low = 1 as shown, row_number() over (partition by size order by path) as rank from h where kind = 'group')
select stream, n, is_key, coalesce(o.layer, 0)::int as layer, (row_number() over (partition by stream order by first, coalesce(rank, 0)) - 1)::bigint as coding, coalesce(shown, true) as shown from l left join o on not is_key and o.size = l.size and o.place = l.place""",
)
def gop_plan(spark, sf):
    """Keys at intervals and cuts, groups that end at keys and at the end, layers and coding order of midpoints."""
    return gop.plan(pkt(spark, sf).withColumn("cut", F.col("event_type") == "signup"))


# ---- records that are repeated, settled later, or must agree

#: Behind every place: where a version ends that no other follows.
NO_END = (1 << 63) - 1

_EVENTS = ", e as (select stream, n, n // 4 as tu, case event_type when 'signup' then 'point' when 'purchase' then 'send' when 'error' then 'other' else 'refer' end as kind, event_id % 3 as key, max((event_type = 'error')::int) over (partition by stream, n // 4) = 1 as leading from pkt)"


@query(
    "pkt",
    _EVENTS
    + """ select r.stream, r.key, p.tu as point, min(r.n) as n from (select * from e where kind = 'refer') r join (select distinct stream, tu from e where kind = 'point') p on p.stream = r.stream and p.tu <= r.tu
where (not r.leading or p.tu = r.tu) and not exists (select 1 from e s where s.kind = 'send' and s.stream = r.stream and s.key = r.key and s.n < r.n and s.tu >= p.tu and (s.tu = p.tu or not s.leading)) group by all""",
)
def random_access_replay(spark, sf):
    """Records that are missing to who begins at an access point."""
    from pyspark.sql import Window

    kind = F.when(F.col("event_type") == "signup", "point").when(F.col("event_type") == "purchase", "send").when(F.col("event_type") == "error", "other").otherwise("refer")
    unit = Window.partitionBy("stream", "tu")
    events = pkt(spark, sf).select("stream", "n", F.floor(F.col("n") / 4).alias("tu"), kind.alias("kind"), (F.col("event_id") % 3).alias("key"), "event_type")
    events = events.withColumn("leading", F.max(F.col("event_type") == "error").over(unit)).drop("event_type")
    return P.replay_findings(events)


@query(
    "pkt",
    """, o as (select *, lead(n) over (partition by stream order by n) as until from pkt where event_type = 'signup')
select o.stream, o.n, min(s.n) as settled_at, arg_min(s.bits, s.n) as settled_by from o left join pkt s on s.stream = o.stream and s.event_type = 'purchase' and s.n > o.n and (o.until is null or s.n <= o.until) group by all""",
)
def settled_units(spark, sf):
    """What settles each unit, reported where the unit begins."""
    rows = pkt(spark, sf).select("stream", "n", "event_type", "bits")
    found = P.settled_later(rows, ["stream"], "n", F.col("event_type") == "signup", F.col("event_type") == "purchase", "bits")
    return found.select("stream", "n", "settled_at", "settled_by")



@query(
    "",
    f"""with v as (select o_custkey as id, o_orderstatus = 'F' as own, o_orderkey as "from", coalesce(lead(o_orderkey) over (partition by o_custkey, o_orderstatus = 'F' order by o_orderkey), max(o_orderkey) over () + 1) as until, o_orderpriority as profile from orders)
select l.id, greatest(l."from", r."from") as since, l.profile as l_profile, r.profile as r_profile from v l join v r on l.id = r.id and l.own and not r.own and l."from" < r.until and r."from" < l.until where l.profile <> r.profile""",
)
def record_agreement(spark, sf):
    """Versions of two kinds of record of one id that are valid together and disagree."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_orderstatus") == "F").alias("own"), F.col("o_orderkey").alias("from"), F.col("o_orderpriority").alias("profile"))
    # the last version of a kind goes on behind all others; one shuffle by id serves both windows
    valid = P.versions(o.dropna(subset=["id", "own", "from"]).repartition("id"), ["id", "own"], "from", F.lit(NO_END))
    met = P.in_force(valid, ["id"], "own")
    return met.where("l_profile <> r_profile").select("id", "since", "l_profile", "r_profile")


# ---- records in slots


def _slots(spark, sf, refs: str, updates: str, slots: int, slot, mask):
    rows = pkt(spark, sf)
    asked = rows.where(F.col("event_type") == refs).select("stream", "n", slot.cast("int").alias("slot"))
    return P.slot_references(asked, rows.where(F.col("event_type") == updates).select("stream", "n", mask.cast("long").alias("mask")), slots)


def _slots_sql(refs: str, updates: str, slot: str, mask: str) -> str:
    return f" select r.stream, r.n, s as slot, max(u.n) as set_at from (select *, ({slot})::int as s from pkt where event_type = '{refs}') r left join (select *, ({mask})::bigint as m from pkt where event_type = '{updates}') u on u.stream = r.stream and u.n < r.n and (u.m >> r.s) & 1 = 1 group by all"


@query("pkt", _slots_sql("click", "purchase", "bits % 16", "1::bigint << (bits % 16)::int"))
def multi_frame_resolution(spark, sf):
    """The multi-frame header that each frame names: the latest of its id, null if none was sent."""
    number = F.col("bits") % 16
    return _slots(spark, sf, "click", "purchase", 16, number, F.call_function("shiftleft", F.lit(1), number.cast("int")))


@query("pkt", _slots_sql("view", "signup", "bits % 15", "bits % 32768"))
def matrix_slot_references(spark, sf):
    """The update that set the quantizer matrix level of each frame; an update sets any of 15 levels."""
    return _slots(spark, sf, "view", "signup", 15, F.col("bits") % 15, F.col("bits") % 32768)


@query("pkt", _slots_sql("view", "error", "event_id % 8", "bits % 256"))
def grain_slot_references(spark, sf):
    """The update that set the grain model of each frame; an update sets any of eight."""
    return _slots(spark, sf, "view", "error", 8, F.col("event_id") % 8, F.col("bits") % 256)


@query("pkt", f"select stream, rule_id, min(n) as n, count(*) as times from ({ORDERED_SQL}) group by all")
def findings_once(spark, sf):
    """Findings of a stream that repeat, each rule once."""
    return P.first_of_each(ordered_findings(spark, sf), ["stream", "rule_id"], "n")


# ---- order of references


@query(
    "",
    """with recursive e as (
  select distinct src, dst from (select doc_id // 2 as src, doc_id as dst from documents where doc_id > 0 union all select doc_id // 3, doc_id from documents where doc_id > 1 union all select doc_id, doc_id // 2 from documents where doc_id > 0 and doc_id % 97 = 0) where src in (select doc_id from documents)
), p(node, level) as (select doc_id, 0 from documents union select e.dst, level + 1 from p join e on e.src = p.node where level < 40)
select node as doc_id, case when max(level) < 40 then max(level)::int end as level from p group by node""",
)
def reference_levels(spark, sf):
    """Levels of documents that refer to those of a half and a third of their number; some refer back, which closes cycles."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("node"))
    to = lambda n: F.floor(F.col("node") / n)
    halves, thirds = (d.where(F.col("node") >= n - 1).select(to(n).alias("src"), F.col("node").alias("dst")) for n in (2, 3))
    halves, thirds = halves.where("dst > 0"), thirds.where("dst > 1")
    back = d.where("node > 0 and node % 97 = 0").select(F.col("node").alias("src"), to(2).alias("dst"))
    found = G.levels(d.withColumn("graph", F.lit(1)), halves.unionByName(thirds).unionByName(back).withColumn("graph", F.lit(1)), ["graph"])
    return found.select(F.col("node").alias("doc_id"), "level")


# ---- palettes and fits


@query(
    "blk px",
    """, c as (select vec_id, v, count(*) as n, row_number() over (partition by vec_id order by count(*) desc, v) as r, count(*) over (partition by vec_id) as kinds from px group by vec_id, v
), s as (select vec_id, v as seed from c where r <= 6
), a as (select c.vec_id, c.v, c.n, c.kinds, (select arg_min(seed, abs(seed - c.v) * 1000 + seed) from s where s.vec_id = c.vec_id) as seed from c
), m as (select vec_id, seed, sum(n * v)::bigint as total, sum(n)::bigint as n, (sum(case when v = seed then n else 0 end))::bigint as exact, max(kinds) as kinds from a group by all
), k as (select distinct vec_id, case when kinds > 6 and exact * 2 < n then (total + n // 2) // n else seed end as colour from m)
select vec_id, count(*)::int as colours, string_agg(colour::int::varchar, ',' order by colour) as palette from k group by vec_id having count(*) >= 2""",
)
def palette_colours(spark, sf):
    """Six colours at most for each block, from its most frequent values."""
    found = blk(spark, sf).select("vec_id", K.palette(F.col("x"), 6).alias("p")).where("p is not null")
    return found.select("vec_id", F.size("p").alias("colours"), F.array_join(F.col("p").cast("array<string>"), ",").alias("palette"))


def _fit_sql() -> str:
    stages, body = [], "sums"
    for k, stage in enumerate(M.elimination()):
        stages.append(f"e{k} as (select *, {', '.join(f'{e} as {n}' for n, e in stage.items())} from {body})")
        body = f"e{k}"
    sums = ", ".join(f"{e} as {n}" for n, e in M.moments("t", "y").items())
    return f", p as (select kind, (qty - 25) / 25.0::double as t, ln(size::double) as y from obu), sums as (select kind, count(*) as n, {sums} from p group by kind), {', '.join(stages)} select kind, n, {', '.join(f'round(c{k}, 6) as c{k}' for k in range(M.ORDER))} from {body}"


@query("obu", _fit_sql())
def cubic_fits(spark, sf):
    """A least-squares cubic of the logarithm of the size over the quantity, for each kind of unit."""
    points = obu(spark, sf).select("kind", ((F.col("qty") - 25) / F.lit(25.0)).alias("t"), F.log(F.col("size").cast("double")).alias("y"))
    fits = M.polynomials(points, ["kind"], "t", "y")
    return fits.select("kind", "n", *[F.round(f"c{k}", 6).alias(f"c{k}") for k in range(M.ORDER)])


# ---- the unit source


@query("", "select doc_id as pts, strlen(coalesce(text, ''))::bigint as size, sha256(coalesce(text, '')) as digest from documents")
def unit_round_trip(spark, sf):
    """Texts written as units of containers and read back by ranges."""
    D.register(spark)
    path = D.working_dir(spark)
    units = table(spark, sf, "documents").select(F.col("doc_id").alias("pts"), F.coalesce("text", F.lit("")).cast("binary").alias("payload"))
    units.write.format("units").mode("append").save(path.removeprefix("file://"))
    got = spark.read.format("units").option("splitBytes", 1 << 20).load(path.removeprefix("file://"))
    return got.select(F.col("pts").cast("long").alias("pts"), "size", F.sha2("payload", 256).alias("digest"))
