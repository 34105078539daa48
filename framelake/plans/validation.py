"""Queries of the stateless checks, with DuckDB text.

A unit is the SHA-256 digest of a text: its first byte or two are a unit header, the rest is its payload.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import headers as H
from ..functions.bits import UNIT_CLASSES, UNIT_TYPES
from ..operators import checks as C
from ..operators import rules as R
from .catalogue import query
from .headers import read_sql
from .views import table

#: Tables that the SQL reads too; those of sequence and multi-frame headers are tested against a writer.
READ = {n: C.TABLES[n] for n in ("Msdo", "BufferRemovalTiming", "ContentInterpretation")}


def digest_units(spark, sf):
    unit = F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    h = B.obu_header(B.byte_at(F.col("unit"), 0), B.byte_at(F.col("unit"), 1), B.GLOBAL_TYPES)
    rows = table(spark, sf, "documents").select("doc_id", unit.alias("unit")).withColumn("h", h)
    # one unit in four ends as a payload should: a one and zeros
    body = F.substring("unit", F.col("h.header_bytes") + 1, F.lit(32))
    body = F.when(F.col("doc_id") % 4 == 0, F.concat(F.substring("unit", F.col("h.header_bytes") + 1, F.lit(2)), F.lit(b"\x80"))).otherwise(body)
    return rows.select("doc_id", "h.type_code", "h.temporal_layer", "h.embedded_layer", "h.extended_layer", body.alias("payload"))


def _in(names) -> str:
    return "type_code in (" + ", ".join(str(UNIT_TYPES.index(n)) for n in names) + ")"


_UNITS = f"""select doc_id, type_code, t, case when b0 >> 7 = 1 then b1 >> 5 else 0 end as m,
    case when b0 >> 7 = 1 then b1 & 31 when {_in(UNIT_CLASSES['requires_global_layer'])} then 31 else 0 end as x,
    case when doc_id % 4 = 0 then substr(u, 3 + 2 * (b0 >> 7), 4) || '80' else substr(u, 3 + 2 * (b0 >> 7)) end as h
  from (select *, (b0 >> 2) & 31 as type_code, b0 & 3 as t from (select doc_id, upper(sha256(coalesce(text, ''))) as u, ('0x' || substr(u, 1, 2))::int as b0, ('0x' || substr(u, 3, 2))::int as b1 from documents))"""


def _tail_sql(digits: str, flag: bool) -> str:
    rest = f"substr({digits}, 2)" if flag else digits
    first = f"when {digits} = '' then 'cut' when starts_with({digits}, '1') then 'extension' " if flag else ""
    return f"case {first}when {rest} = '' then 'empty' when starts_with({rest}, '0') then 'missing one bit' when contains(substr({rest}, 2), '1') then 'zero bit not zero' else 'ok' end"


def _checks_sql() -> str:
    reserved = f"(type_code = 0 or type_code >= {len(UNIT_TYPES)})"
    header = [
        ("global-xlayer-required", "error", f"{_in(UNIT_CLASSES['requires_global_layer'])} and x <> 31"),
        ("global-xlayer-requires-base-layers", "error", "x = 31 and (m <> 0 or t <> 0)"),
        ("global-xlayer-allowed-types", "error", f"x = 31 and not {_in(UNIT_CLASSES['permits_global_layer'])}"),
        ("base-layer-only-types", "error", f"{_in(UNIT_CLASSES['requires_base_layers'])} and (t <> 0 or m <> 0)"),
        ("temporal-layer-zero-only-types", "error", f"{_in(C.LAYER_ZERO)} and t <> 0"),
        ("reserved-obu-type", "info", reserved),
    ]
    none = "null::bigint as bit"
    parts = [f"select doc_id, 'obu-header/{rule}' as rule_id, '{severity}' as severity, {none} from u where {when}" for rule, severity, when in header]
    parts.append(f"select doc_id, 'msdo/non-global-layer-id', 'error', {none} from u where {_in(['Msdo'])} and (t <> 0 or m <> 0 or x <> 31)")
    parts.append(f"select doc_id, 'obu-reserved/all-zero-payload', 'error', {none} from u where {reserved} and h <> '' and ltrim(h, '0') = ''")
    tails = "case v " + " ".join(f"when '{k}' then '{v}'" for k, v in C.TAIL_RULES.items()) + " end"
    digits = "array_to_string(list_transform(range(length(h) // 2), lambda i: right(('0x' || substr(h, (2 * i + 1)::int, 2))::int::bit::varchar, 8)), '')"
    parts.append(f"select doc_id, {tails}, 'error', 0 from (select doc_id, {_tail_sql(digits, False)} as v from u where {_in(['TemporalDelimiter'])} and h <> '') where v <> 'ok'")
    kept = "regexp_replace(h, '(00)+$', '')"
    parts.append(f"select doc_id, case when {kept} = '' then 'padding/all-zero-payload' else 'padding/invalid-trailing-bits' end, 'error', {none} from u where {_in(['Padding'])} and h <> '' and right({kept}, 2) <> '80'")
    fields = {
        "Msdo": [
            ("msdo/too-many-streams", "error", "num_streams_minus_2 > 2"),
            *[("msdo/profile-below-substream-max", "error", f"sub_{k}_max_profile > multistream_profile_idc") for k in range(9)],
            ("annex-a/profile-reserved", "error", "multistream_profile_idc between 5 and 30"),
        ],
        "ContentInterpretation": [
            ("content-interpretation/reserved-bits-nonzero", "warning", "reserved_2bit <> 0"),
            ("content-interpretation/chroma-sample-position-out-of-range", "error", "greatest(chroma_sample_position_top, chroma_sample_position_bottom) > 5"),
            ("content-interpretation/aspect-ratio-idc-out-of-range", "error", "aspect_ratio_idc > 16 and aspect_ratio_idc <> 255"),
        ],
    }
    rules = "case split_part(error, ':', 2) " + " ".join(f"when '{k}' then '{v}'" for k, v in C.FIELD_RULES.items()) + " else 'bitstream/parse-error' end"
    ctes = []
    for name, syntax in READ.items():
        own = read_sql(syntax, f"select * from u where {_in([name])}", ["doc_id", "h"])
        flag = name in UNIT_CLASSES["is_extensible"]
        ctes.append(f"r_{name} as materialized (select *, {_tail_sql(f'substr({digits}, (bits + 1)::int)', flag)} as v from ({own}))")
        parts.append(f"select doc_id, case when starts_with(error, 'range') then {rules} else 'bitstream/parse-error' end, 'error', bits from r_{name} where error is not null")
        parts.append(f"select doc_id, {tails}, 'error', bits from r_{name} where error is null and h <> '' and v <> 'ok'")
        parts += [f"select doc_id, '{rule}', '{severity}', {none} from r_{name} where error is null and {when}" for rule, severity, when in fields.get(name, [])]
    return f"with u as ({_UNITS}), " + ", ".join(ctes) + "\n" + "\nunion all\n".join(parts)


@query("", _checks_sql())
def stateless_checks(spark, sf):
    """Findings of the header and payload checks over one unit for each document."""
    return C.check_units(digest_units(spark, sf), ["doc_id"], READ)


@query("", f"select rule_id, severity, count(*) as n from ({_checks_sql()}) group by all")
def stateless_report(spark, sf):
    return R.report(C.check_units(digest_units(spark, sf), ["doc_id"], READ))
