"""Header structures read from bytes of the driver's tables, with DuckDB text made from the same tables of fields.

The bytes are those of a text's SHA-256 digest and then the text itself: any bits are a payload, and
most headers end in a fault somewhere, which is part of the result.  The SQL reads one field a
step from a string of binary digits; it shares names, order and conditions with the table of fields,
and nothing with the way Spark reads it.  Tests check the tables against hand-made payloads.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import headers as H
from ..functions.bits import UNIT_TYPES
from ..functions.syntax import MOST_SIZES, Field, Syntax, _inside
from .catalogue import query
from .views import table

#: Bytes that the SQL turns into digits: more than most tables of fields can need, and the longest payload here.
SQL_BYTES, ALL_BYTES = 400, 2000


def _args(text: str, at: int) -> tuple[list[str], int]:
    """Arguments of a call whose bracket opens at a place, and the place behind it."""
    depth, parts, begin = 0, [], at + 1
    for k in range(at, len(text)):
        depth += {"(": 1, ")": -1}.get(text[k], 0)
        if depth == 1 and text[k] == "," or depth == 0:
            parts.append(text[begin:k])
            begin = k + 1
        if depth == 0:
            return parts, k + 1
    raise ValueError(text)


def duck(text: str) -> str:
    """An expression of a table of fields in DuckDB's dialect."""
    for name, sign in (("shiftright", ">>"), ("shiftleft", "<<")):
        while (at := text.find(f"{name}(")) >= 0:
            (a, b), end = _args(text, at + len(name))
            text = f"{text[:at]}(({a})::bigint {sign} ({b})::int){text[end:]}"
    return re.sub(r"\bdiv\b", "//", text).replace("seq.", "seq_").replace("mfh.", "mfh_").replace("here", "pos")


def _read(f: Field) -> tuple[str, str, str]:
    """(value, bits used, malformed) over pos, bits, left (bits that are left), n and cap."""
    at = lambda p, n: f"(case when {n} = 0 then 0 else ('0b' || substr(bits, ({p} + 1)::int, ({n})::int))::bigint end)"
    if f.kind == "f":
        return at("pos", "n"), "n", "false"
    if f.kind == "su":
        return f"({at('pos', 'n')} - case when {at('pos', '1')} = 1 then (1::bigint << n::int) else 0 end)", "n", "false"
    zeros = "(strpos(substr(bits, (pos + 1)::int), '1') - 1)"
    if f.kind == "uvlc":
        z = f"(case when {zeros} < 0 then left_ else {zeros} end)"
        return f"({at(f'(pos + {z} + 1)', z)} + (1::bigint << {z}::int) - 1)", f"(2 * {z} + 1)", f"{z} >= 32"
    if f.kind == "ns":
        w = "length(ltrim(n::bigint::bit::varchar, '0'))"
        v, m = at("pos", f"({w} - 1)"), f"((1::bigint << {w}::int) - n)"
        return f"(case when {v} < {m} then {v} else 2 * {v} - {m} + {at(f'(pos + {w} - 1)', '1')} end)", f"(case when {v} < {m} then {w} - 1 else {w} end)", "n < 1"
    if f.kind == "leb":
        byte = lambda k: at(f"(pos + {8 * k})", "8")
        ends = "case " + " ".join(f"when left_ >= {8 * k + 8} and {byte(k)} < 128 then {k + 1}" for k in range(8)) + " end"
        value = " + ".join(f"case when ({ends}) > {k} then ({byte(k)} & 127) << {7 * k} else 0 end" for k in range(8))
        return f"({value})", f"(8 * coalesce({ends}, 99))", f"(coalesce({ends}, 9) = 9 and left_ >= 64 or ({value}) >= 4294967296)"
    ones = "(strpos(substr(bits, (pos + 1)::int) || '0', '0') - 1)"
    if f.kind == "unary":
        return f"least({ones}, n)", f"(least({ones}, n) + ({ones} < n)::int)", "false"
    if f.kind == "rg":
        return f"(({ones}::bigint << n::int) + {at(f'(pos + {ones} + 1)', 'n')})", f"({ones} + 1 + n)", f"{ones} >= 32"
    return "n", "0", "false"


def _cover() -> str:
    """Starts of tiles of coded sizes: a fold over struct(start, used, starts)."""
    r = "least(n - a.start, cap)"
    w = f"length(ltrim(({r})::bigint::bit::varchar, '0'))"
    v = f"(case when {w} = 1 then 0 else ('0b' || rpad(substr(bits, (pos + a.used + 1)::int, ({w} - 1)::int), ({w} - 1)::int, '0'))::bigint end)"
    m = f"((1::bigint << {w}::int) - {r})"
    more = f"('0b' || rpad(substr(bits, (pos + a.used + {w})::int, 1), 1, '0'))::bigint"
    size = f"(case when {v} < {m} then {v} + 1 else 2 * {v} - {m} + {more} + 1 end)"
    used = f"(case when {v} < {m} then {w} - 1 else {w} end)"
    none = "{'start': 0::bigint, 'used': 0::bigint, 'starts': []::bigint[]}"
    grown = f"{{'start': (a.start + {size})::bigint, 'used': (a.used + {used})::bigint, 'starts': list_append(a.starts, a.start)}}"
    return f"list_reduce(list_transform(range({MOST_SIZES + 1}), lambda k: {none}), lambda a, b: case when a.start >= n or a.used > left_ then a else {grown} end)"


def read_sql(syntax: Syntax, source: str, keep: list[str], most: int = SQL_BYTES) -> str:
    """DuckDB text: the kept columns of source (which has hex digits `h` of the payload), the named values, error and bits."""
    steps = [
        f"s0 as (select *, 8 * (length(h) // 2) as all_bits, array_to_string(list_transform(range(least(length(h) // 2, {most})), lambda i: right(('0x' || substr(h, (2 * i + 1)::int, 2))::int::bit::varchar, 8)), '') as bits, 0::bigint as pos, null::varchar as err from ({source}))"
    ]
    for k, f in enumerate(syntax.fields):
        when = f"coalesce(({duck(f.when)}), false)" if f.when else "true"
        absent = "null" if f.absent is None else str(f.absent)
        if f.kind == "widest":
            name = f.cap[1:]
            n = f"list_max(list_transform(l_{name}, lambda x, j: coalesce(l_{name}[j + 1], {duck(str(f.width))}) - x))"
        else:
            n = duck(str(f.width))
        cap = duck(f.cap) if f.kind in ("cover", "list") else "0"
        prepared = f"(select *, err is null and {when} as go, all_bits - pos as left_, case when {when} then ({n})::bigint end as n, case when {when} then ({cap})::bigint end as cap from s{k})"
        if f.kind == "cover":
            inner = f"(select *, case when go then {_cover()} end as c from {prepared})"
            fault = "case when n < 1 or cap < 1 then 'code' when c.used > left_ then 'eof' when c.start < n then 'range' end"
            value, used, extra, drop = "len(c.starts)", "c.used", f", case when go then c.starts end as l_{f.name}", ", c"
        elif f.kind == "list":
            ok = "n * cap <= left_"
            inner = f"(select *, go and coalesce({ok}, false) as ok from {prepared})"
            fault, value, used, drop = "case when not ok then 'eof' end", "case when ok then n end", "case when ok then n * cap else 0 end", ", ok"
            extra = f", case when ok then list_transform(range(n), lambda i: ('0b' || substr(bits, (pos + i * cap + 1)::int, cap::int))::bigint) end as l_{f.name}"
        else:
            value, used, bad = _read(f)
            ok = f"not ({bad}) and {used} <= left_"
            inner = f"(select *, go and coalesce({ok}, false) as ok from {prepared})"
            # a code of 32 zeros is malformed, one that the end cuts off is not whole
            fault = f"case when {bad} and left_ >= 32 then 'code' when not ok then {'case when ' + bad + ' then ' + repr('code') + ' else ' + repr('eof') + ' end' if f.kind == 'ns' else repr('eof')} end"
            value, used, extra, drop = f"case when ok then {value} end", f"case when ok then {used} else 0 end", "", ", ok"
        read = f"(select * exclude (go, left_, n, cap{drop}), case when go then ({value})::bigint when err is null then {absent} end as v, case when go then ({fault}) end as fault, case when go then {used} else 0 end as used, go{extra} from {inner})"
        check = re.sub(rf"\b{f.name}\b", "v", duck(f.check)) if f.check else "true"
        bad = f"coalesce(fault, case when go and not coalesce({check}, false) then 'range' end)"
        steps.append(f"s{k + 1} as {'materialized ' if k % 16 == 15 else ''}(select * exclude (v, fault, used, go, pos, err), case when {bad} is null then v end as {f.name}, case when {bad} is null then pos + used else pos end as pos, coalesce(err, {bad} || ':{f.name}') as err from {read})")
    names = [f.name for f in syntax.fields if not _inside(f.name)]
    return "with " + ",\n".join(steps) + f"\nselect {', '.join(keep)}, {', '.join(names)}, err as error, pos as bits from s{len(syntax.fields)}"


PAYLOAD_SQL = "select doc_id, upper(sha256(coalesce(text, ''))) || hex(encode(substr(coalesce(text, ''), 1, 400))) as h from documents"


def _payload():
    """The digest of a text, then its first characters."""
    text = F.coalesce("text", F.lit(""))
    return F.unhex(F.concat(F.sha2(text.cast("binary"), 256), F.hex(F.substring(text, 1, 400).cast("binary"))))


def documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", _payload().alias("payload"))


def _flat(df, syntax: Syntax, keep: list[str]):
    names = [f.name for f in syntax.fields if not _inside(f.name)]
    return df.select(*keep, *[F.col(f"header.{n}").alias(n) for n in names], F.col("header_error").alias("error"), F.col("header_bits").alias("bits"))


@query("", read_sql(H.SEQUENCE_GENERAL, PAYLOAD_SQL, ["doc_id"]))
def sequence_headers(spark, sf):
    """Sequence headers up to the layer maps, one for each document."""
    return _flat(H.SEQUENCE_GENERAL.parsed(documents(spark, sf)), H.SEQUENCE_GENERAL, ["doc_id"])


_TYPE_SQL = "('0x' || substr(md5(coalesce(text, '')), 1, 2))::int & 31"


def _type():
    return F.conv(F.substring(F.md5(F.coalesce("text", F.lit("")).cast("binary")), 1, 2), 16, 10).cast("int").bitwiseAND(31)


def typed_documents(spark, sf):
    """Payloads with a unit type from another digest of the text."""
    return table(spark, sf, "documents").select("doc_id", _type().alias("type_code"), _payload().alias("payload"))


@query("", read_sql(H.FRAME_PREFIX, PAYLOAD_SQL.replace("doc_id,", f"doc_id, {_TYPE_SQL} as type_code,"), ["doc_id", "type_code"]))
def frame_header_prefixes(spark, sf):
    """The ids that a frame header begins with; bridge frames name no multi-frame header."""
    return _flat(H.FRAME_PREFIX.parsed(typed_documents(spark, sf)), H.FRAME_PREFIX, ["doc_id", "type_code"])


# ---- child configurations: read from bit 0, with what they need of the general part taken from the digest's first bits


def _given(bits: dict[str, tuple[int, int]], salt: str = "") -> dict:
    """Columns cut from the first 60 bits of another digest, by offset from the lowest bit and width."""
    word = F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.coalesce("text", F.lit(""))).cast("binary")), 1, 15), 16, 10).cast("long")
    return {name: F.shiftright(word, at).bitwiseAND((1 << n) - 1) for name, (at, n) in bits.items()}


def _given_sql(bits: dict[str, tuple[int, int]], prefix: str = "", salt: str = "") -> str:
    word = f"('0x' || substr(md5('{salt}' || coalesce(text, '')), 1, 15))::bigint"
    return "".join(f"(({word} >> {at}) & {(1 << n) - 1}) as {prefix}{name}, " for name, (at, n) in bits.items())


def _config_query(name: str, syntax: Syntax, doc: str, most: int = SQL_BYTES, **bits: tuple[int, int]) -> None:
    keep = ["doc_id", *bits]

    def run(spark, sf):
        rows = table(spark, sf, "documents").select("doc_id", *[c.alias(n) for n, c in _given(bits).items()], _payload().alias("payload"))
        return _flat(syntax.parsed(rows), syntax, keep)

    run.__name__, run.__doc__ = name, doc
    query("", read_sql(syntax, PAYLOAD_SQL.replace("doc_id,", "doc_id, " + _given_sql(bits)), keep, most))(run)


GENERAL_BITS = {"single_picture_header_flag": (0, 1), "chroma_format_idc": (1, 2)}
_config_query("sequence_partition_configs", Syntax(H.PARTITION, H.INTRA, H.SCREEN), "Partition, intra and screen content tools.", **GENERAL_BITS)
_config_query("sequence_segment_infos", Syntax(H.SEGMENT[:43]), "Segments: features of ten segments and what comes before.")
_config_query("sequence_inter_configs", Syntax(H.INTER), "Reference frames and inter tools.", **GENERAL_BITS)
_config_query("sequence_transform_configs", Syntax(H.TRANSFORM, H.FILTER), "Transform, quantizer, entropy and loop filter tools.", **GENERAL_BITS, use_256x256_superblock=(3, 1), use_128x128_superblock=(4, 1))
_config_query("timing_infos", H.TIMING_INFO, "Display ticks.")
_config_query("content_interpretations", H.CONTENT, "Scan type, colour, sample positions, aspect ratio and timing.")
_config_query("multistream_operations", H.MSDO, "Streams of a multistream operation.")
_config_query("buffer_removal_timings", H.REMOVAL, "Removal times, one or for each operating point.")
_config_query(
    "tile_layouts",
    Syntax(H.tiles("", "frame_width", "frame_height", "(4 + superblock)", "true")),
    "Uniform tiles and tiles of coded sizes, with what levels allow.",
    frame_width=(0, 13), frame_height=(13, 12), superblock=(25, 1), seq_level_idx=(26, 5), seq_tier=(31, 1),
)

#: What a frame header takes from the active sequence header.
SEQUENCE_BITS = {
    "single_picture_header_flag": (5, 1), "num_ref_frames_minus_1": (6, 3), "long_term_frame_id_bits": (9, 2), "monotonic_output_order_flag": (11, 1), "order_hint_bits_minus_1": (12, 3), "max_mlayer_id": (15, 1), "seq_header_id": (16, 4),
    "enable_short_refresh_frame_flags": (20, 1), "frame_width_bits_minus_1": (21, 4), "frame_height_bits_minus_1": (25, 4), "max_frame_width_minus_1": (29, 9), "max_frame_height_minus_1": (38, 9), "seq_screen_content_tools": (47, 1), "seq_integer_mv": (48, 2), "allow_frame_max_bvp_drl_bits": (50, 1), "film_grain_params_present": (51, 1),
}


TYPE_BITS = {"type_code": (0, 5)}
_FRAME_SOURCE = PAYLOAD_SQL.replace("doc_id,", f"doc_id, {_given_sql(TYPE_BITS)}{_given_sql(SEQUENCE_BITS, 'seq_')}64 as mfh_mfh_frame_width_minus_1, 48 as mfh_mfh_frame_height_minus_1, ")


@query("", read_sql(H.FRAME_START, _FRAME_SOURCE, ["doc_id", "type_code"]))
def frame_headers(spark, sf):
    """Frame headers up to the tiles, with the fields of the active sequence header that they depend on."""
    seq = F.struct(*[c.alias(n) for n, c in _given(SEQUENCE_BITS).items()])
    mfh = F.struct(F.lit(64).alias("mfh_frame_width_minus_1"), F.lit(48).alias("mfh_frame_height_minus_1"))
    rows = table(spark, sf, "documents").select("doc_id", _given(TYPE_BITS)["type_code"].cast("int").alias("type_code"), seq.alias("seq"), mfh.alias("mfh"), _payload().alias("payload"))
    return _flat(H.FRAME_START.parsed(rows), H.FRAME_START, ["doc_id", "type_code"])

#: Types whose payloads the query below reads, with their tables; of sequence headers the general part.
DISPATCHED = {n: H.SEQUENCE_GENERAL if t is H.SEQUENCE else t for n, t in H.BY_TYPE.items() if t is not H.MULTI_FRAME}


def _dispatch_sql() -> str:
    tables: dict[int, tuple[Syntax, list[int]]] = {}
    for name, t in DISPATCHED.items():
        tables.setdefault(id(t), (t, []))[1].append(UNIT_TYPES.index(name))
    source, parts = PAYLOAD_SQL.replace("doc_id,", f"doc_id, {_TYPE_SQL} as type_code,"), []
    for t, codes in tables.values():
        good = "prefix" if t is H.FRAME_PREFIX else "parsed"
        own = f"select * from ({source}) where type_code in ({', '.join(map(str, codes))})"
        parts.append(f"select doc_id, type_code, case when error is null then '{good}' else 'malformed' end as status, error as syntax_error from ({read_sql(t, own, ['doc_id', 'type_code'], ALL_BYTES if t is H.FILM_GRAIN else SQL_BYTES)})")
    known = ", ".join(str(UNIT_TYPES.index(n)) for n in DISPATCHED)
    parts.append(f"select doc_id, type_code, case when type_code = 0 or type_code >= {len(UNIT_TYPES)} then 'reserved' else 'opaque' end, null from ({source}) where type_code not in ({known})")
    return "\nunion all\n".join(parts)


@query("", _dispatch_sql())
def payload_dispatch(spark, sf):
    """What each payload turns out to be by its unit type."""
    return H.payloads(typed_documents(spark, sf), kinds=DISPATCHED).select("doc_id", "type_code", "status", "syntax_error")


@query("", read_sql(H.SEQUENCE, PAYLOAD_SQL, ["doc_id"]))
def sequence_headers_whole(spark, sf):
    """Whole sequence headers: child configurations, segments and tiles."""
    return _flat(H.SEQUENCE.parsed(documents(spark, sf)), H.SEQUENCE, ["doc_id"])


_config_query("multi_frame_headers", H.MULTI_FRAME, "Sizes, deblocking and segments that frames share.")


def _laid_out(names: list[tuple[str, int]]) -> dict[str, tuple[int, int]]:
    """(name, width) one behind the other from bit 0; 60 bits at most."""
    out, at = {}, 0
    for name, width in names:
        out[name] = (at, width)
        at += width
    if at > 60:
        raise ValueError(f"{at} bits")
    return out


#: More of the sequence header, for tiles, quantizers and filters, and of a multi-frame header; each group from a digest of its own.
TOOLS = _laid_out([("use_256x256_superblock", 1), ("use_128x128_superblock", 1), ("seq_level_idx", 4), ("seq_tier", 1), ("enable_avg_cdf", 1), ("avg_cdf_type", 1), ("bit_depth_idc", 1), ("chroma_format_idc", 2), ("y_dc_delta_q_enabled", 1), ("uv_dc_delta_q_enabled", 1), ("uv_ac_delta_q_enabled", 1), ("separate_uv_delta_q", 1), ("equal_ac_dc_q", 1), ("seq_tile_info_present_flag", 1), ("allow_tile_info_change", 1), ("seq_uniform", 1), ("seq_sb_cols", 2), ("seq_sb_rows", 2), ("seq_tile_cols", 2), ("seq_tile_rows", 2), ("seq_tile_cols_log2", 1), ("seq_tile_rows_log2", 1)])
FILTER_TOOLS = _laid_out([("enable_ext_seg", 1), ("seq_seg_info_present_flag", 1), ("seq_allow_seg_info_change", 1), ("base_y_dc_delta_q", 5), ("base_uv_dc_delta_q", 5), ("base_uv_ac_delta_q", 5), ("choose_tcq_per_frame", 1), ("enable_tcq", 1), ("enable_parity_hiding", 1), ("df_par_bits_minus_2", 2), ("enable_gdf", 1), ("gdf_unit_matches_sb_size", 1), ("disable_loopfilters_across_tiles", 1), ("enable_cdef", 1), ("cdef_on_skip_txfm_always_on", 1), ("cdef_on_skip_txfm_disabled", 1)])
ALTS = _laid_out([(f"seq_segment_{k}_alt_q", 3) for k in range(16)])
SHARED = _laid_out([("mfh_seg_info_present_flag", 1), ("mfh_ext_seg_flag", 1), ("mfh_allow_seg_info_change", 1), ("mfh_deblocking_filter_update", 1), *[(f"mfh_apply_deblocking_filter_{k}", 1) for k in range(4)], ("mfh_frame_width_minus_1", 9), ("mfh_frame_height_minus_1", 9)])
SHARED_ALTS = _laid_out([(f"mfh_segment_{k}_alt_q", 3) for k in range(16)])
FRAME_VALUES = _laid_out([("base_q_idx", 1), ("delta_q_y_dc", 3), ("delta_q_u_dc", 3), ("delta_q_v_dc", 3), ("delta_q_u_ac", 3), ("delta_q_v_ac", 3), ("mi_cols", 7), ("mi_rows", 7), ("tile_cols", 2), ("tile_rows", 2), ("odd_start", 1)])
_GROUPS = {"seq": [(SEQUENCE_BITS, ""), (TOOLS, "t"), (FILTER_TOOLS, "f"), (ALTS, "a")], "mfh": [(SHARED, "m"), (SHARED_ALTS, "b")]}


def _contexts() -> list:
    return [F.struct(*[c.alias(n) for bits, salt in groups for n, c in _given(bits, salt).items()]).alias(name) for name, groups in _GROUPS.items()]


_CONTEXT_SQL = "".join(_given_sql(bits, f"{name}_", salt) for name, groups in _GROUPS.items() for bits, salt in groups)


@query("", read_sql(H.FRAME, PAYLOAD_SQL.replace("doc_id,", f"doc_id, {_given_sql(TYPE_BITS)}{_CONTEXT_SQL}"), ["doc_id", "type_code"]))
def frame_headers_whole(spark, sf):
    """Frame headers with tiles and quantizers, under any sequence and multi-frame header."""
    rows = table(spark, sf, "documents").select("doc_id", _given(TYPE_BITS)["type_code"].cast("int").alias("type_code"), *_contexts(), _payload().alias("payload"))
    return _flat(H.FRAME.parsed(rows), H.FRAME, ["doc_id", "type_code"])


@query("", read_sql(H.FRAME_FILTERS, PAYLOAD_SQL.replace("doc_id,", f"doc_id, {_given_sql(FRAME_VALUES, salt='v')}{_CONTEXT_SQL}"), ["doc_id"]))
def frame_filters(spark, sf):
    """Segmentation, matrices, lossless segments, deblocking, guided and directional filters of intra frames."""
    values = [c.alias(n) for n, c in _given(FRAME_VALUES, "v").items()]
    rows = table(spark, sf, "documents").select("doc_id", *values, *_contexts(), _payload().alias("payload"))
    return _flat(H.FRAME_FILTERS.parsed(rows), H.FRAME_FILTERS, ["doc_id"])


_config_query("film_grain_models", H.FILM_GRAIN, "Grain of eight slots: scaling points and autoregression coefficients.", ALL_BYTES)
_config_query("tile_group_heads", H.TILE_GROUP, "Heads of tile groups.", type_code=(0, 5))
_config_query("tile_group_structures", H.TILE_GROUP_STRUCTURE, "First and last tile of a group, and where its tiles begin.", num_tiles=(0, 3), tile_bits=(3, 3))
