"""Header structures as syntax tables: sequence headers, frame headers, layer and timing records.

Names, order, descriptors and ranges of the fields are fixed values of the format.  A table is read
by `Syntax.parsed`; `payloads` chooses the table by the type of a unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .syntax import Field, Syntax, flag, tile_log2

u = Field  # a field with its descriptor and width


def uvlc(name: str, when: str | None = None, check: str | None = None, absent: int | None = None) -> Field:
    return Field(name, "uvlc", 1, when, absent, check)


# ---- sequence header

MANY = "single_picture_header_flag = 0"
COLOUR = "chroma_format_idc <> 1"

GENERAL = [
    uvlc("seq_header_id", check="seq_header_id < 16"),
    u("seq_profile_idc", "f", 5),
    flag("single_picture_header_flag"),
    u("seq_level_idx", "f", 5),
    flag("seq_tier", f"seq_level_idx > 3 and {MANY}", 0),
    uvlc("chroma_format_idc", check="chroma_format_idc < 4"),
    uvlc("bit_depth_idc", check="bit_depth_idc < 2"),
    u("seq_lcr_id", "f", 3, MANY, 0),
    flag("still_picture", MANY, 1),
    u("max_tlayer_id", "f", 2, MANY, 0),
    u("max_mlayer_id", "f", 3, MANY, 0),
    u("seq_max_mlayer_cnt_minus_1", "f", tile_log2("1", "max_mlayer_id + 1", 4), "max_mlayer_id > 0", 0, "seq_max_mlayer_cnt_minus_1 <= max_mlayer_id"),
    flag("monotonic_output_order_flag", MANY, 1),
    u("frame_width_bits_minus_1", "f", 4),
    u("frame_height_bits_minus_1", "f", 4),
    u("max_frame_width_minus_1", "f", "frame_width_bits_minus_1 + 1"),
    u("max_frame_height_minus_1", "f", "frame_height_bits_minus_1 + 1"),
    flag("seq_cropping_window_present_flag"),
    *[uvlc(f"seq_cropping_win_{side}_offset", "seq_cropping_window_present_flag = 1", f"seq_cropping_win_{side}_offset <= max_frame_{axis}_minus_1", 0) for side, axis in (("left", "width"), ("right", "width"), ("top", "height"), ("bottom", "height"))],
    flag("seq_initial_display_delay_present_flag", MANY, 0),
    u("seq_initial_display_delay_minus_1", "f", 4, "seq_initial_display_delay_present_flag = 1"),
    flag("decoder_model_info_present_flag", MANY, 0),
    u("num_units_in_decoding_tick", "f", 32, "decoder_model_info_present_flag = 1", None, "num_units_in_decoding_tick > 0"),
    flag("seq_decoder_model_info_present_flag", "decoder_model_info_present_flag = 1", 0),
    uvlc("decoder_buffer_delay", "seq_decoder_model_info_present_flag = 1"),
    uvlc("encoder_buffer_delay", "seq_decoder_model_info_present_flag = 1"),
    flag("low_delay_mode_flag", "seq_decoder_model_info_present_flag = 1"),
    flag("mlayer_dependency_present_flag", "max_mlayer_id > 0", 0),
    # rows of the map from layer 1 up, each from the layer itself down to 0: 2 + 3 + ... bits
    u("mlayer_dependency_bits", "f", "cast(max_mlayer_id * (max_mlayer_id + 3) / 2 as int)", "mlayer_dependency_present_flag = 1"),
    flag("tlayer_dependency_present_flag", "max_tlayer_id > 0", 0),
    flag("multi_tlayer_dependency_map_present_flag", "tlayer_dependency_present_flag = 1 and max_mlayer_id > 0", 0),
    *[
        u(f"tlayer_dependency_bits_{m}", "f", "cast(max_tlayer_id * (max_tlayer_id + 3) / 2 as int)", "tlayer_dependency_present_flag = 1" + (f" and multi_tlayer_dependency_map_present_flag = 1 and max_mlayer_id >= {m}" if m else ""))
        for m in range(8)
    ],
]

PARTITION = [
    flag("use_256x256_superblock"),
    flag("use_128x128_superblock", "use_256x256_superblock = 0", 0),
    flag("enable_sdp", COLOUR, 0),
    flag("enable_extended_sdp", f"enable_sdp = 1 and {MANY}", 0),
    flag("enable_ext_partitions"),
    flag("enable_uneven_4way_partitions", "enable_ext_partitions = 1", 0),
    flag("reduce_pb_aspect_ratio"),
    flag("max_pb_aspect_ratio_log2_minus_1", "reduce_pb_aspect_ratio = 1", 2),
]


def segments(prefix: str, count: int, given: str, extended: str) -> list[Field]:
    """Three features of each segment: a signed quantizer offset and two flags without data; 16 segments where `extended` holds, else 8."""
    out = []
    for s in range(count):
        when = given if s < 8 else f"{given} and {extended}"
        out += [flag(f"{prefix}_{s}_alt_q_enabled", when), Field(f"{prefix}_{s}_alt_q", "su", 10, f"{prefix}_{s}_alt_q_enabled = 1"), flag(f"{prefix}_{s}_feature_1", when), flag(f"{prefix}_{s}_feature_2", when)]
    return out


SEGMENT = [
    flag("enable_ext_seg"),
    flag("seq_seg_info_present_flag"),
    flag("seq_allow_seg_info_change", "seq_seg_info_present_flag = 1"),
    *segments("seq_segment", 16, "seq_seg_info_present_flag = 1", "enable_ext_seg = 1"),
]

INTRA = [
    flag("enable_dip"),
    flag("enable_intra_edge_filter"),
    flag("enable_mrls"),
    flag("enable_cfl_intra"),
    u("cfl_ds_filter_index", "f", 2, COLOUR, 0),
    flag("enable_mhccp"),
    flag("enable_ibp"),
]

INTER = [
    *[flag(f"seq_enabled_motion_mode_{m}", MANY, 0) for m in range(1, 5)],
    flag("seq_frame_motion_modes_present_flag", "seq_enabled_motion_mode_1 + seq_enabled_motion_mode_2 + seq_enabled_motion_mode_3 + seq_enabled_motion_mode_4 > 0", 0),
    flag("enable_six_param_warp_delta", "seq_enabled_motion_mode_3 = 1", 0),
    flag("enable_masked_compound", MANY, 0),
    flag("enable_ref_frame_mvs", MANY, 0),
    flag("reduced_ref_frame_mvs_mode", "enable_ref_frame_mvs = 1", 0),
    u("order_hint_bits_minus_1", "f", 4, MANY),
    flag("enable_refmvbank"),
    flag("disable_drl_reorder"),
    flag("constrain_drl_reorder", "disable_drl_reorder = 0"),
    flag("explicit_ref_frame_map", MANY, 0),
    flag("explicit_num_ref_frames", MANY, 0),
    u("num_ref_frames_minus_1", "f", 4, "explicit_num_ref_frames = 1"),
    u("long_term_frame_id_bits", "f", 3, MANY, 0),
    u("seq_max_drl_bits_minus_1", "ns", 5, MANY, 0),
    flag("allow_frame_max_drl_bits", MANY, 0),
    u("seq_max_bvp_drl_bits_minus_1", "ns", 3),
    flag("allow_frame_max_bvp_drl_bits"),
    u("num_same_ref_compound", "f", 2, MANY, 0),
    flag("enable_tip", MANY, 0),
    flag("disable_tip_output", "enable_tip = 1", 1),
    flag("enable_tip_hole_fill", "enable_tip = 1", 0),
    flag("enable_mv_traj", MANY, 0),
    flag("enable_bawp"),
    flag("enable_cwp", MANY, 0),
    flag("enable_imp_msk_bld", MANY, 0),
    flag("enable_df_sub_pu", MANY, 0),
    flag("enable_tip_explicit_qp", "disable_tip_output = 0 and enable_df_sub_pu = 1", 0),
    u("enable_opfl_refine", "f", 2, MANY, 0),
    flag("enable_refinemv", MANY, 0),
    flag("enable_tip_refinemv", "enable_tip = 1 and (enable_opfl_refine <> 0 or enable_refinemv = 1)", 0),
    *[flag(name, MANY, 0) for name in ("enable_bru", "enable_adaptive_mvd", "enable_mvd_sign_derive", "enable_flex_mvres", "enable_global_motion", "enable_short_refresh_frame_flags")],
]

SCREEN = [
    flag("seq_choose_screen_content_tools", MANY, 1),
    flag("seq_screen_content_tools", "seq_choose_screen_content_tools = 0", 2),
    flag("seq_choose_integer_mv", f"{MANY} and seq_screen_content_tools > 0", 1),
    flag("seq_integer_mv", "seq_choose_integer_mv = 0", 2),
]

TRANSFORM = [
    flag("enable_fsc"),
    flag("enable_idtx_intra", "enable_fsc = 0", 1),
    flag("enable_intra_ist"),
    flag("enable_inter_ist"),
    flag("enable_chroma_dctonly", COLOUR, 0),
    flag("enable_inter_ddt", MANY, 0),
    flag("reduced_tx_part_set"),
    flag("enable_cctx", COLOUR, 0),
    flag("enable_tcq"),
    flag("choose_tcq_per_frame", f"enable_tcq = 1 and {MANY}", 0),
    flag("enable_parity_hiding", "enable_tcq = 0 or choose_tcq_per_frame = 1", 0),
    flag("enable_avg_cdf", MANY, 1),
    flag("avg_cdf_type", f"{MANY} and enable_avg_cdf = 1"),
    flag("separate_uv_delta_q", COLOUR, 0),
    flag("equal_ac_dc_q"),
    u("base_y_dc_delta_q", "f", 5, "equal_ac_dc_q = 0", 0),
    flag("y_dc_delta_q_enabled", "equal_ac_dc_q = 0", 0),
    u("base_uv_dc_delta_q", "f", 5, f"{COLOUR} and equal_ac_dc_q = 0"),
    flag("uv_dc_delta_q_enabled", f"{COLOUR} and equal_ac_dc_q = 0", 0),
    u("base_uv_ac_delta_q", "f", 5, COLOUR, 0),
    flag("uv_ac_delta_q_enabled", COLOUR, 0),
]

FILTER = [
    flag("disable_loopfilters_across_tiles"),
    flag("enable_cdef"),
    flag("enable_gdf"),
    flag("gdf_unit_matches_sb_size", "enable_gdf = 1 and use_256x256_superblock = 0 and use_128x128_superblock = 0", 0),
    flag("enable_restoration"),
    flag("lr_pc_wiener_disabled", "enable_restoration = 1", 0),
    flag("lr_wiener_nonsep_disabled", "enable_restoration = 1", 0),
    flag("lr_tools_uv_present", "enable_restoration = 1", 0),
    flag("lr_uv_wiener_nonsep_disabled", "lr_tools_uv_present = 1"),
    flag("enable_ccso"),
    flag("ccso_unit_matches_sb_size", "enable_ccso = 1", 0),
    flag("cdef_on_skip_txfm_always_on", MANY, 0),
    flag("cdef_on_skip_txfm_disabled", f"{MANY} and cdef_on_skip_txfm_always_on = 0", 0),
    u("df_par_bits_minus_2", "f", 2),
]


def _scaled(tier: str, level: str, main: list[tuple[int, int]], high: list[tuple[int, int]]) -> str:
    """A factor by level: the value of the first bound that a level lies under, 0 beyond."""
    steps = lambda bounds: "case " + " ".join(f"when {level} < {b} then {v}" for b, v in bounds) + " else 0 end"
    return f"(case when {tier} = 0 then {steps(main)} else {steps(high)} end)"


#: Tile width and area factors of levels below each bound, for the main and the high tier.
WIDTH_FACTOR = [(18, 4), (22, 8)], [(14, 4), (18, 8), (22, 16)]
AREA_FACTOR = [(14, 4), (18, 8), (22, 16)], [(14, 4), (18, 16), (22, 32)]
MAX_TILE_WIDTH, MAX_TILE_AREA, MAX_TILES = 4096, 4096 * 2304, 64


def tiles(p: str, width: str, height: str, shift: str, when: str, uniform_shift: str | None = None, reuse: str | None = None) -> list[Field]:
    """tile_params(): rows and columns of tiles of a frame, in superblocks of 4 << shift samples; needs seq_tier and seq_level_idx.

    Uniform tiles are spaced by superblocks of uniform_shift; others have sizes of their own.  Where `reuse`
    holds, nothing is read and the tiles of the sequence header seq are taken.
    """
    coded = f"{when} and {reuse} = 0" if reuse else when
    even = f"{when} and {p}uniform = 1"
    own = f"{coded} and {p}uniform = 0"
    let = lambda name, value, cond=when: Field(f"{p}{name}", "let", value, cond)
    us = uniform_shift or shift

    def spaced(axis: str, log2: str) -> list[Field]:
        """Tiles of one size, and one superblock more for the first ones while whole superblocks are left over."""
        mis = f"{p}mi_{axis}s"
        return [
            let(f"_{axis}_whole", f"shiftright({mis}, cast({us} as int))", even),
            let(f"_{axis}_all", f"shiftright({mis} + shiftleft(1, cast({us} as int)) - 1, cast({us} as int))", even),
            let(f"{axis}_each", f"shiftright({p}_{axis}_whole, cast({log2} as int))", even),
            let(f"{axis}_extra", f"case when {p}{axis}_each = 0 then {p}_{axis}_all else {p}_{axis}_whole - shiftleft({p}{axis}_each, cast({log2} as int)) end", even),
            # starts grow by each (+ 1): so many of them lie below the whole
            let(
                f"uniform_{axis}s",
                f"least(shiftleft(1, cast({log2} as int)), case when {p}_{axis}_all <= {p}{axis}_extra * ({p}{axis}_each + 1) then cast(ceil({p}_{axis}_all / ({p}{axis}_each + 1)) as bigint) else {p}{axis}_extra + cast(ceil(({p}_{axis}_all - {p}{axis}_extra * ({p}{axis}_each + 1)) / greatest({p}{axis}_each, 1)) as bigint) end)",
                even,
            ),
        ]

    def chosen(axis: str) -> str:
        own = f"{p}_least_{axis}_log2 + {p}_more_{axis}"
        return f"coalesce({own}, seq.seq_tile_{axis}_log2)" if reuse else own

    level, tier = ("seq.seq_level_idx", "seq.seq_tier") if reuse else ("seq_level_idx", "seq_tier")
    limited = f"{level} <> 31"
    width_factor, area_factor = (_scaled(tier, level, *f) for f in (WIDTH_FACTOR, AREA_FACTOR))
    return [
        let("mi_cols", f"2 * shiftright({width} + 7, 3)"),
        let("mi_rows", f"2 * shiftright({height} + 7, 3)"),
        let("sb_cols", f"shiftright({p}mi_cols + shiftleft(1, cast({shift} as int)) - 1, cast({shift} as int))"),
        let("sb_rows", f"shiftright({p}mi_rows + shiftleft(1, cast({shift} as int)) - 1, cast({shift} as int))"),
        Field(f"{p}_max_width", "let", f"case when {limited} then shiftright({width_factor} * {MAX_TILE_WIDTH}, cast({shift} + 4 as int)) else {p}sb_cols end", when, None, f"{p}_max_width > 0"),
        let("_max_area", f"case when {limited} then shiftright({area_factor} * {MAX_TILE_AREA}, cast(2 * ({shift} + 2) + 2 as int)) else {p}sb_cols * {p}sb_rows end"),
        let("_least_cols_log2", tile_log2(f"{p}_max_width", f"{p}sb_cols")),
        let("_most_cols_log2", tile_log2("1", f"least({p}sb_cols, {MAX_TILES})", 7)),
        let("_most_rows_log2", tile_log2("1", f"least({p}sb_rows, {MAX_TILES})", 7)),
        let("_least_log2", f"greatest({p}_least_cols_log2, {tile_log2(f'{p}_max_area', f'{p}sb_cols * {p}sb_rows')})"),
        flag(f"{p}_own_uniform", coded),
        let("uniform", f"coalesce({p}_own_uniform, seq.seq_uniform)" if reuse else f"{p}_own_uniform"),
        Field(f"{p}_more_cols", "unary", f"greatest({p}_most_cols_log2 - {p}_least_cols_log2, 0)", f"{coded} and {p}uniform = 1"),
        let("_coded_cols_log2", chosen("cols"), even),
        *spaced("col", f"{p}_coded_cols_log2"),
        let("_least_rows_log2", f"greatest({p}_least_log2 - {tile_log2('1', f'{p}uniform_cols', 8)}, 0)", even),
        Field(f"{p}_more_rows", "unary", f"greatest({p}_most_rows_log2 - {p}_least_rows_log2, 0)", f"{coded} and {p}uniform = 1"),
        let("_coded_rows_log2", chosen("rows"), even),
        *spaced("row", f"{p}_coded_rows_log2"),
        Field(f"{p}own_cols", "cover", f"{p}sb_cols", own, None, None, f"{p}_max_width"),
        Field(f"{p}_widest", "widest", f"{p}sb_cols", own, None, None, f"@{p}own_cols"),
        let("_own_area", f"case when {p}_least_log2 > 0 then shiftright({p}sb_cols * {p}sb_rows, cast({p}_least_log2 + 1 as int)) else {p}sb_cols * {p}sb_rows end", own),
        Field(f"{p}own_rows", "cover", f"{p}sb_rows", own, None, None, f"greatest(1, {p}_own_area div {p}_widest)"),
        let("tile_cols", f"coalesce({p}uniform_cols, {p}own_cols" + (", seq.seq_tile_cols)" if reuse else ")")),
        let("tile_rows", f"coalesce({p}uniform_rows, {p}own_rows" + (", seq.seq_tile_rows)" if reuse else ")")),
        let("tile_cols_log2", tile_log2("1", f"{p}tile_cols", 8)),
        let("tile_rows_log2", tile_log2("1", f"{p}tile_rows", 8)),
    ]


#: log2 of a superblock's side in units of four samples.
SB_SHIFT = "(4 + 2 * use_256x256_superblock + use_128x128_superblock)"
TILE = [
    flag("seq_tile_info_present_flag"),
    flag("allow_tile_info_change", "seq_tile_info_present_flag = 1"),
    *tiles("seq_", "max_frame_width_minus_1 + 1", "max_frame_height_minus_1 + 1", SB_SHIFT, "seq_tile_info_present_flag = 1"),
]

#: sequence_header_obu()
SEQUENCE = Syntax(GENERAL, PARTITION, SEGMENT, INTRA, INTER, SCREEN, TRANSFORM, FILTER, TILE, [flag("film_grain_params_present")])
#: Its first part, up to the layer maps.
SEQUENCE_GENERAL = Syntax(GENERAL)

TIMING = [
    u("num_units_in_display_tick", "f", 32, None, None, "num_units_in_display_tick > 0"),
    u("time_scale", "f", 32, None, None, "time_scale > 0"),
    flag("equal_picture_interval"),
    uvlc("num_ticks_per_picture_minus_1", "equal_picture_interval = 1", "num_ticks_per_picture_minus_1 < 4294967295"),
]
#: timing_info()
TIMING_INFO = Syntax(TIMING)


def layer_map(bits: Column, layers: Column, present: Column) -> Column:
    """array of (layer, reference) that a dependency map allows; where it is absent each layer may use itself and all lower ones.

    bits holds the rows from layer 1 up, each from the layer itself down to 0.
    """
    width = F.shiftright(layers * (layers + 3), 1)
    row = lambda c: F.transform(F.sequence(F.lit(0).cast("long"), c), lambda r: F.struct(c.alias("layer"), r.alias("reference")))
    # the bit of (c, r) stands behind those of the rows before, c - r places into its own row
    place = lambda x: width - 1 - (F.shiftright((x["layer"] - 1) * (x["layer"] + 2), 1) + x["layer"] - x["reference"])
    given = lambda x: F.call_function("shiftright", bits, place(x).cast("int")).bitwiseAND(1) == 1
    cells = F.flatten(F.transform(F.sequence(F.lit(1).cast("long"), layers), row))
    zero = F.array(F.struct(F.lit(0).cast("long").alias("layer"), F.lit(0).cast("long").alias("reference")))
    return F.when(layers == 0, zero).otherwise(F.concat(zero, F.filter(cells, lambda x: (present != 1) | given(x))))


# ---- frame headers

#: Codes of unit types that frame headers tell apart.
CLOSED_KEY, OPEN_KEY, SWITCH, LEADING_SEF, REGULAR_SEF, BRIDGE, RAS = 4, 5, 10, 11, 12, 19, 21
KEY, INTER_ONLY, INTRA_ONLY, SWITCHED = 0, 1, 2, 3
PREFIX = [
    uvlc("cur_mfh_id", f"type_code <> {BRIDGE}", None, 0),
    uvlc("seq_header_id_in_frame_header", "cur_mfh_id = 0"),
]
#: The ids that a frame header begins with; needs type_code beside the payload.
FRAME_PREFIX = Syntax(PREFIX)

REFS = "coalesce(seq.num_ref_frames_minus_1 + 1, case when seq.single_picture_header_flag = 1 then 2 else 8 end)"
REF_BITS = tile_log2("1", REFS, 5)
BODY = "_known = 1 and show_existing_frame = 0"
SEVERAL = f"{BODY} and seq.single_picture_header_flag = 0"
INTRA_FRAME = f"{BODY} and frame_is_intra = 1"
SIZED = f"{INTRA_FRAME} and frame_width is not null"
FRAME_SB_SHIFT = "(4 + greatest(seq.use_256x256_superblock, seq.use_128x128_superblock))"
SEQ_SB_SHIFT = "(4 + 2 * seq.use_256x256_superblock + seq.use_128x128_superblock)"
CHROMA_Q = f"{SIZED} and seq.chroma_format_idc <> 1 and (seq.uv_ac_delta_q_enabled = 1 or coalesce(seq.uv_dc_delta_q_enabled, 0) = 1)"


def delta_q(name: str, when: str) -> list[Field]:
    return [flag(f"{name}_coded", when, 0), Field(name, "su", 7, f"{name}_coded = 1", 0)]


def _even(log2: str, sbs: str) -> str:
    """SQL: whether so many uniform tiles leave the last one a superblock at least."""
    n = f"shiftleft(1, cast({log2} as int))"
    w = f"shiftright({sbs} + {n} - 1, cast({log2} as int))"
    return f"({w} >= 1 and {sbs} - ({n} - 1) * {w} >= 1)"


FRAME_FIELDS = [
    *PREFIX,
    Field("_known", "let", "cast(seq.seq_header_id is not null as int)"),
    Field("bridge_frame_ref_idx", "f", REF_BITS, f"_known = 1 and type_code = {BRIDGE}"),
    Field("show_existing_frame", "let", f"cast(seq.single_picture_header_flag = 0 and type_code in ({LEADING_SEF}, {REGULAR_SEF}) as int)", "_known = 1"),
    Field("frame_to_show_map_idx", "f", REF_BITS, "show_existing_frame = 1"),
    flag("derive_sef_order_hint", "show_existing_frame = 1"),
    Field("sef_order_hint_lsb", "f", "coalesce(seq.order_hint_bits_minus_1 + 1, 0)", "derive_sef_order_hint = 0"),
    flag("apply_grain", "show_existing_frame = 1 and seq.film_grain_params_present = 1", 0),
    Field("fgm_id", "f", 3, "apply_grain = 1"),
    Field("grain_seed", "f", 16, "apply_grain = 1"),
    flag("restricted_prediction_switch", f"{SEVERAL} and type_code in ({SWITCH}, {RAS})"),
    flag("frame_is_inter", f"{SEVERAL} and type_code in (6, 7)"),
    Field("frame_type", "let", f"case when seq.single_picture_header_flag = 1 or type_code in ({CLOSED_KEY}, {OPEN_KEY}) then {KEY} when type_code in ({SWITCH}, {RAS}) then {SWITCHED} when frame_is_inter = 0 then {INTRA_ONLY} else {INTER_ONLY} end", BODY),
    Field("frame_is_intra", "let", f"cast(frame_type in ({KEY}, {INTRA_ONLY}) and type_code <> {BRIDGE} as int)", BODY),
    Field("long_term_id_plus_1", "f", "seq.long_term_frame_id_bits", f"{SEVERAL} and frame_type = {KEY}"),
    Field("num_key_ref_frames", "f", 3, f"{SEVERAL} and type_code in ({RAS}, {OPEN_KEY}) and seq.long_term_frame_id_bits <> 0"),
    *[Field(f"ref_long_term_id_{k}", "f", "seq.long_term_frame_id_bits", f"num_key_ref_frames > {k}") for k in range(7)],
    flag("immediate_output_frame", f"{SEVERAL} and type_code not in ({OPEN_KEY}, {BRIDGE})", 0),
    flag("implicit_output_frame", f"{SEVERAL} and type_code <> {BRIDGE} and immediate_output_frame = 0 and seq.monotonic_output_order_flag = 0", 0),
    flag("frame_size_override_flag", f"{SEVERAL} and frame_type <> {SWITCHED} and type_code <> {BRIDGE}"),
    Field("order_hint_lsb", "f", "coalesce(seq.order_hint_bits_minus_1 + 1, 0)", f"{BODY} and type_code <> {BRIDGE}"),
    # refreshed slots: all of a lone key frame, one by number, or a mask
    Field("_all_slots", "let", f"cast(frame_type = {KEY} and type_code = {CLOSED_KEY} and seq.max_mlayer_id = 0 as int)", INTRA_FRAME),
    flag("has_refresh_frame_flags", f"{INTRA_FRAME} and _all_slots = 0 and frame_type = {INTRA_ONLY} and seq.enable_short_refresh_frame_flags = 1", 1),
    Field("frame_to_refresh", "f", REF_BITS, f"{INTRA_FRAME} and _all_slots = 0 and has_refresh_frame_flags = 1 and seq.enable_short_refresh_frame_flags = 1"),
    Field("_mask", "f", REFS, f"{INTRA_FRAME} and _all_slots = 0 and seq.enable_short_refresh_frame_flags = 0"),
    Field("refresh_frame_flags", "let", f"case when _all_slots = 1 then shiftleft(1, cast({REFS} as int)) - 1 when frame_to_refresh is not null then shiftleft(1, cast(frame_to_refresh as int)) else coalesce(_mask, 0) end", INTRA_FRAME),
    Field("frame_width_minus_1", "f", "seq.frame_width_bits_minus_1 + 1", f"{INTRA_FRAME} and frame_size_override_flag = 1"),
    Field("frame_height_minus_1", "f", "seq.frame_height_bits_minus_1 + 1", f"{INTRA_FRAME} and frame_size_override_flag = 1"),
    Field("frame_width", "let", "coalesce(frame_width_minus_1, case when cur_mfh_id = 0 then seq.max_frame_width_minus_1 else mfh.mfh_frame_width_minus_1 end) + 1", INTRA_FRAME),
    Field("frame_height", "let", "coalesce(frame_height_minus_1, case when cur_mfh_id = 0 then seq.max_frame_height_minus_1 else mfh.mfh_frame_height_minus_1 end) + 1", INTRA_FRAME),
    flag("_choose_tools", f"{INTRA_FRAME} and seq.seq_screen_content_tools = 2"),
    Field("allow_screen_content_tools", "let", "coalesce(_choose_tools, cast(seq.seq_screen_content_tools <> 0 as int))", INTRA_FRAME),
    flag("_choose_integer_mv", f"{INTRA_FRAME} and allow_screen_content_tools = 1 and seq.seq_integer_mv = 2"),
    Field("force_integer_mv", "let", "case when allow_screen_content_tools = 0 then 0 else coalesce(_choose_integer_mv, cast(seq.seq_integer_mv <> 0 as int)) end", INTRA_FRAME),
    flag("allow_intrabc", INTRA_FRAME),
    flag("allow_global_intrabc", "allow_intrabc = 1"),
    flag("allow_local_intrabc", "allow_global_intrabc = 1"),
    flag("change_bvp_drl", "allow_intrabc = 1 and seq.allow_frame_max_bvp_drl_bits = 1"),
    Field("max_bvp_drl_bits_minus_1", "ns", 2, "change_bvp_drl = 1"),
    flag("disable_cdf_update", INTRA_FRAME),
    # tile_info(): the sequence's tiles where they fit, else tiles of the frame's own
    Field("_sb_cols", "let", f"shiftright(2 * shiftright(frame_width + 7, 3) + shiftleft(1, cast({FRAME_SB_SHIFT} as int)) - 1, cast({FRAME_SB_SHIFT} as int))", SIZED),
    Field("_sb_rows", "let", f"shiftright(2 * shiftright(frame_height + 7, 3) + shiftleft(1, cast({FRAME_SB_SHIFT} as int)) - 1, cast({FRAME_SB_SHIFT} as int))", SIZED),
    Field("_fits", "let", f"cast(seq.seq_tile_info_present_flag = 1 and case when seq.seq_uniform = 1 then {_even('seq.seq_tile_rows_log2', '_sb_rows')} and {_even('seq.seq_tile_cols_log2', '_sb_cols')} else seq.seq_sb_cols = _sb_cols and seq.seq_sb_rows = _sb_rows end as int)", SIZED),
    flag("_choose_reuse", f"{SIZED} and _fits = 1 and seq.allow_tile_info_change = 1"),
    Field("reuse_tile_info", "let", "case when _fits = 1 then coalesce(_choose_reuse, 1) else 0 end", SIZED),
    *tiles("", "frame_width", "frame_height", FRAME_SB_SHIFT, SIZED, SEQ_SB_SHIFT, "reuse_tile_info"),
    Field("context_update_tile_id", "f", "tile_rows_log2 + tile_cols_log2", f"{SIZED} and tile_cols * tile_rows > 1 and (seq.enable_avg_cdf = 0 or coalesce(seq.avg_cdf_type, 1) = 0)", 0),
    Field("tile_size_bytes_minus_1", "f", 2, f"{SIZED} and tile_cols * tile_rows > 1"),
    # quantization_params()
    Field("base_q_idx", "f", "9 - seq.bit_depth_idc", SIZED),
    *delta_q("delta_q_y_dc", f"{SIZED} and seq.y_dc_delta_q_enabled = 1"),
    flag("diff_uv_delta", f"{CHROMA_Q} and seq.separate_uv_delta_q = 1", 0),
    *delta_q("_u_dc", f"{CHROMA_Q} and seq.uv_dc_delta_q_enabled = 1"),
    *delta_q("_u_ac", f"{CHROMA_Q} and seq.uv_ac_delta_q_enabled = 1"),
    *delta_q("_v_dc", f"{CHROMA_Q} and diff_uv_delta = 1 and seq.uv_dc_delta_q_enabled = 1"),
    *delta_q("_v_ac", f"{CHROMA_Q} and diff_uv_delta = 1 and seq.uv_ac_delta_q_enabled = 1"),
    Field("delta_q_u_dc", "let", "case when seq.equal_ac_dc_q = 1 then _u_ac else _u_dc end", SIZED),
    Field("delta_q_u_ac", "let", "_u_ac", SIZED),
    Field("delta_q_v_dc", "let", "case when diff_uv_delta = 0 then delta_q_u_dc when seq.equal_ac_dc_q = 1 then _v_ac else _v_dc end", SIZED),
    Field("delta_q_v_ac", "let", "case when diff_uv_delta = 0 then _u_ac else _v_ac end", SIZED),
]
#: Its part up to disable_cdf_update.
FRAME_START = Syntax(FRAME_FIELDS[: next(k for k, f in enumerate(FRAME_FIELDS) if f.name == "disable_cdf_update") + 1])
#: A frame header up to its quantizers, for intra frames; up to the order hint for others.  Needs, beside the payload,
#: type_code, seq (the active sequence header, null if there is none) and mfh (the multi-frame header, likewise).
FRAME = Syntax(FRAME_FIELDS)


def frame_status(header: str = "header") -> Column:
    """How far a frame header could be read."""
    h = F.col(header)
    return (
        F.when(F.col(f"{header}_error").isNotNull(), "malformed")
        .when(F.col("seq").isNull(), "activation fields only")
        .when(h["show_existing_frame"] == 1, "show existing frame")
        .when(h["frame_is_intra"] == 0, "inter header begun")
        .when(h["frame_width"].isNull(), "multi-frame header missing")
        .otherwise("through quantization")
    )


# ---- other records

#: multistream_decoder_operation(): two to nine streams
MSDO = Syntax(
    u("num_streams_minus_2", "f", 3),
    u("multistream_profile_idc", "f", 5),
    u("multistream_level_idx", "f", 5),
    flag("multistream_tier"),
    flag("multistream_even_allocation_flag"),
    u("multistream_large_picture_idc", "f", 3, "multistream_even_allocation_flag = 0"),
    [Field(f"sub_{k}_{name}", "f", w, f"num_streams_minus_2 + 2 > {k}") for k in range(9) for name, w in (("xlayer_id", 5), ("max_profile", 5), ("max_level", 5), ("max_tier", 1))],
    flag("multistream_doh_constraint_flag"),
)

#: multi_frame_header_obu()
MULTI_FRAME = Syntax(
    uvlc("mfh_seq_header_id"),
    uvlc("mfh_id_minus_1"),
    flag("mfh_frame_size_present_flag"),
    u("mfh_frame_width_bits_minus_1", "f", 4, "mfh_frame_size_present_flag = 1"),
    u("mfh_frame_height_bits_minus_1", "f", 4, "mfh_frame_size_present_flag = 1"),
    u("mfh_frame_width_minus_1", "f", "mfh_frame_width_bits_minus_1 + 1", "mfh_frame_size_present_flag = 1"),
    u("mfh_frame_height_minus_1", "f", "mfh_frame_height_bits_minus_1 + 1", "mfh_frame_size_present_flag = 1"),
    flag("mfh_deblocking_filter_update"),
    [flag(f"mfh_apply_deblocking_filter_{k}", "mfh_deblocking_filter_update = 1", 0) for k in range(4)],
    flag("mfh_seg_info_present_flag"),
    flag("mfh_ext_seg_flag", "mfh_seg_info_present_flag = 1"),
    flag("mfh_allow_seg_info_change", "mfh_seg_info_present_flag = 1"),
    segments("mfh_segment", 16, "mfh_seg_info_present_flag = 1", "mfh_ext_seg_flag = 1"),
)

#: buffer_removal_timing(): one time, or one for each operating point
REMOVAL = Syntax(
    flag("br_ops_dependent_flag"),
    u("br_ops_id", "f", 4, "br_ops_dependent_flag = 1"),
    u("br_ops_cnt", "f", 3, "br_ops_dependent_flag = 1"),
    [f for k in range(7) for f in (flag(f"br_decoder_model_present_{k}", f"br_ops_cnt > {k}"), Field(f"br_time_op_{k}", "rg", 4, f"br_decoder_model_present_{k} = 1"))],
    Field("br_time", "rg", 4, "br_ops_dependent_flag = 0"),
)

#: content_interpretation()
CONTENT = Syntax(
    u("scan_type_idc", "f", 2),
    [flag(f"{name}_present_flag") for name in ("color_description", "chroma_sample_position", "aspect_ratio_info", "timing_info")],
    u("reserved_2bit", "f", 2),
    Field("color_description_idc", "rg", 2, "color_description_present_flag = 1"),
    [u(name, "f", 8, "color_description_idc = 0") for name in ("color_primaries", "transfer_characteristics", "matrix_coefficients")],
    flag("full_range_flag", "color_description_present_flag = 1"),
    uvlc("chroma_sample_position_top", "chroma_sample_position_present_flag = 1"),
    # a progressive picture (scan type 1) has one position
    uvlc("chroma_sample_position_bottom", "chroma_sample_position_present_flag = 1 and scan_type_idc <> 1"),
    u("aspect_ratio_idc", "f", 8, "aspect_ratio_info_present_flag = 1"),
    uvlc("sar_width", "aspect_ratio_idc = 255"),
    uvlc("sar_height", "aspect_ratio_idc = 255"),
    [Field(f.name, f.kind, f.width, f"timing_info_present_flag = 1 and {f.when}" if f.when else "timing_info_present_flag = 1", None, f.check) for f in TIMING],
)



def _points(p: str, name: str, when: str) -> list[Field]:
    """Scaling points: numbers that hold an increment and, in their low bits, a scaling."""
    some = f"{p}num_{name}_points > 0"
    return [
        u(f"{p}num_{name}_points", "f", 4, when, 0),
        u(f"{p}{name}_increment_bits_minus_1", "f", 3, some),
        u(f"{p}{name}_scaling_bits_minus_5", "f", 2, some),
        Field(f"{p}{name}_points", "list", f"{p}num_{name}_points", some, None, None, f"{p}{name}_increment_bits_minus_1 + 1 + {p}{name}_scaling_bits_minus_5 + 5"),
    ]


def _coefficients(p: str, name: str, count: str, when: str) -> list[Field]:
    return [u(f"{p}ar_{name}_bits_minus_5", "f", 2, when), Field(f"{p}ar_{name}", "list", count, when, None, None, f"{p}ar_{name}_bits_minus_5 + 5")]


def grain_model(p: str, there: str) -> list[Field]:
    """Grain of one slot; autoregression coefficients are stored above the middle of their range."""
    coloured = f"{there} and chroma_idc <> 1"
    chroma = f"{coloured} and {p}chroma_scaling_from_luma = 0"
    luma = f"2 * {p}ar_coeff_lag * ({p}ar_coeff_lag + 1)"
    out = [flag(f"{p}chroma_scaling_from_luma", coloured, 0), *_points(p, "y", there), *_points(p, "cb", chroma), *_points(p, "cr", chroma)]
    out += [u(f"{p}grain_scaling_minus_8", "f", 2, there), u(f"{p}ar_coeff_lag", "f", 2, there), *_coefficients(p, "y", luma, f"{p}num_y_points > 0")]
    for c in ("cb", "cr"):
        out += _coefficients(p, c, f"{luma} + cast({p}num_y_points > 0 as int)", f"{there} and ({p}chroma_scaling_from_luma = 1 or {p}num_{c}_points > 0)")
    out += [u(f"{p}ar_coeff_shift_minus_6", "f", 2, there), u(f"{p}grain_scale_shift", "f", 2, there)]
    out += [u(f"{p}{c}_{name}", "f", w, f"{p}num_{c}_points > 0") for c in ("cb", "cr") for name, w in (("mult", 8), ("luma_mult", 8), ("offset", 9))]
    return [*out, flag(f"{p}overlap_flag", there), flag(f"{p}clip_to_restricted_range", there), flag(f"{p}mc_identity", f"{p}clip_to_restricted_range = 1", 0), flag(f"{p}film_grain_block_size", there)]


#: film_grain(): models of the slots that the flags name, slot 0 in the lowest bit
FILM_GRAIN = Syntax(u("update_flags", "f", 8), uvlc("chroma_idc"), [f for k in range(8) for f in grain_model(f"g{k}_", f"(update_flags & {1 << k}) > 0")])

#: The head of a metadata unit in short form; what it holds follows.
METADATA_SHORT = Syntax(flag("metadata_is_suffix"), u("muh_layer_idc", "f", 3), flag("muh_cancel_flag"), u("muh_persistence_idc", "f", 3), Field("metadata_type", "leb"))

#: The head of a tile group: a first one begins with a frame header. Needs type_code.
TILE_GROUP = Syntax(
    flag("is_first_tile_group"),
    flag("frame_header_present_flag", "is_first_tile_group = 0", 1),
    [Field(f.name, f.kind, f.width, f"is_first_tile_group = 1 and {f.when}", None if f.name != "cur_mfh_id" else 0) for f in PREFIX],
)
#: What follows the frame header of a tile group, up to its tiles; needs num_tiles and tile_bits.
TILE_GROUP_STRUCTURE = Syntax(
    flag("tile_start_and_end_present_flag", "num_tiles > 1", 0),
    u("_start", "f", "tile_bits", "tile_start_and_end_present_flag = 1"),
    u("_end", "f", "tile_bits", "tile_start_and_end_present_flag = 1"),
    Field("tg_start", "let", "coalesce(_start, 0)"),
    Field("tg_end", "let", "coalesce(_end, num_tiles - 1)"),
    Field("zero_bit", "f", "(8 - here % 8) % 8", None, None, "zero_bit = 0"),
    Field("header_bytes", "let", "cast(here / 8 as bigint)"),
)

#: Tables by unit type; frame headers are read as far as their ids here, as more of them needs other records.
BY_TYPE = {
    "SequenceHeader": SEQUENCE, "MultiFrameHeader": MULTI_FRAME, "BufferRemovalTiming": REMOVAL, "Msdo": MSDO, "ContentInterpretation": CONTENT, "FilmGrain": FILM_GRAIN, "MetadataShort": METADATA_SHORT,
    **dict.fromkeys(["ClosedLoopKey", "OpenLoopKey", "LeadingSef", "RegularSef", "LeadingTip", "RegularTip", "Switch", "BridgeFrame", "RasFrame"], FRAME_PREFIX),
}


def payloads(units: DataFrame, data: str = "payload", kinds: dict[str, Syntax] | None = None) -> DataFrame:
    """units (type_code, payload) with `status`, `syntax_error` and `fields`, the named values as JSON.

    Each payload is read by the table of its type and no other.  status is parsed, prefix (ids of a
    frame header), reserved, opaque (a type without a table here) or malformed.
    """
    from .bits import UNIT_TYPES

    out, status, error, fields = units, F.when(F.col("type_code") >= len(UNIT_TYPES), "reserved").when(F.col("type_code") == 0, "reserved"), F.lit(None).cast("string"), F.lit(None).cast("string")
    tables: dict[int, tuple[Syntax, list[int]]] = {}
    for name, table in (kinds or BY_TYPE).items():
        tables.setdefault(id(table), (table, []))[1].append(UNIT_TYPES.index(name))
    for k, (table, codes) in enumerate(tables.values()):
        own = F.col("type_code").isin(codes)
        out = table.with_state(out, f"_state{k}", data, when=f"type_code in ({', '.join(map(str, codes))})")
        fault = F.col(f"_state{k}.error")
        error = F.when(own, fault).otherwise(error)
        fields = F.when(own, F.to_json(table.named(f"_state{k}"))).otherwise(fields)
        status = status.when(own, F.when(fault.isNotNull(), "malformed").otherwise("prefix" if table is FRAME_PREFIX else "parsed"))
    return out.select(*units.columns, status.otherwise("opaque").alias("status"), error.alias("syntax_error"), fields.alias("fields"))


# ---- what follows the quantizers of an intra frame, up to the filter strengths

#: Least offset of a coded base quantizer difference, and the least side of a filter block.
LEAST_BASE_DELTA, GDF_SIDE = -23, 128
SEGMENTS = 16
LOSSY = "coded_lossless = 0"
MFH_SEGMENTS = "coalesce(mfh.mfh_seg_info_present_flag, 0) = 1"


def _qm_levels(k: int) -> list[Field]:
    on = f"using_qmatrix = 1 and pic_qm_num_minus_1 >= {k}"
    own = f"{on} and seq.chroma_format_idc <> 1"
    return [u(f"qm_y_{k}", "f", 4, on), flag(f"qm_uv_same_as_y_{k}", own), u(f"qm_u_{k}", "f", 4, f"qm_uv_same_as_y_{k} = 0"), u(f"qm_v_{k}", "f", 4, f"qm_uv_same_as_y_{k} = 0 and seq.separate_uv_delta_q = 1")]


def _lossless(k: int) -> list[Field]:
    """Whether a segment is lossless, and the matrices it takes."""
    there = "seq.enable_ext_seg = 1" if k >= 8 else "base_q_idx is not null"
    taken = f"coalesce(case when {MFH_SEGMENTS} then mfh.mfh_segment_{k}_alt_q else seq.seq_segment_{k}_alt_q end, 0)"
    alt = f"case when segmentation_enabled = 0 then 0 when reuse_seg_info = 1 then {taken} else coalesce(segment_{k}_alt_q, 0) end"
    return [
        Field(f"lossless_{k}", "let", f"cast(base_q_idx + {alt} <= 0 and delta_q_present = 0 and _no_delta = 1 as int)", there),
        Field(f"qm_index_{k}", "f", tile_log2("1", "pic_qm_num_minus_1 + 1", 3), f"{there} and using_qmatrix = 1 and lossless_{k} = 0"),
    ]


def _strength(name: str, when: str) -> list[Field]:
    return [flag(f"{name}_pri_zero", when), u(f"{name}_pri_strength", "f", 4, f"{name}_pri_zero = 0", 0), u(f"{name}_sec_code", "f", 2, when)]


_BASE = "case when seq.equal_ac_dc_q = 1 then {ac} else {least} + {dc} end"
_DC_Y = _BASE.format(ac=0, least=LEAST_BASE_DELTA, dc="seq.base_y_dc_delta_q")
_AC_UV = f"({LEAST_BASE_DELTA} + seq.base_uv_ac_delta_q)"
_DC_UV = _BASE.format(ac=_AC_UV, least=LEAST_BASE_DELTA, dc="coalesce(seq.base_uv_dc_delta_q, 0)")

#: segmentation, matrices, per-block quantizers, lossless segments, deblocking, guided and directional filters of an intra frame.
#: Needs, beside the payload, seq, mfh (null if there is none) and from the frame header base_q_idx, delta_q_*, mi_cols, mi_rows, tile_cols,
#: tile_rows and odd_start (1 where a tile begins at an odd superblock).
FRAME_FILTERS = Syntax(
    flag("segmentation_enabled"),
    Field("_have", "let", f"cast(coalesce(case when {MFH_SEGMENTS} then mfh.mfh_ext_seg_flag = seq.enable_ext_seg else seq.seq_seg_info_present_flag = 1 end, false) as int)", "segmentation_enabled = 1"),
    flag("_choose_reuse_seg", f"_have = 1 and case when {MFH_SEGMENTS} then mfh.mfh_allow_seg_info_change = 1 else seq.seq_allow_seg_info_change = 1 end"),
    Field("reuse_seg_info", "let", "coalesce(_choose_reuse_seg, _have)", "segmentation_enabled = 1", 0),
    segments("segment", SEGMENTS, "segmentation_enabled = 1 and reuse_seg_info = 0", "seq.enable_ext_seg = 1"),
    flag("using_qmatrix"),
    u("pic_qm_num_minus_1", "f", 2, "using_qmatrix = 1 and segmentation_enabled = 1", 0),
    [f for k in range(4) for f in _qm_levels(k)],
    flag("delta_q_present", "base_q_idx > 0", 0),
    u("delta_q_res", "f", 2, "delta_q_present = 1", 0),
    Field("_no_delta", "let", f"cast(delta_q_y_dc + {_DC_Y} <= 0 and delta_q_u_dc + {_DC_UV} <= 0 and delta_q_v_dc + {_DC_UV} <= 0 and delta_q_u_ac + {_AC_UV} <= 0 and delta_q_v_ac + {_AC_UV} <= 0 as int)"),
    [f for k in range(SEGMENTS) for f in _lossless(k)],
    Field("coded_lossless", "let", "least(" + ", ".join(f"coalesce(lossless_{k}, 1)" for k in range(SEGMENTS)) + ")"),
    flag("_choose_tcq", f"{LOSSY} and seq.choose_tcq_per_frame = 1"),
    Field("allow_tcq", "let", f"case when {LOSSY} then coalesce(_choose_tcq, seq.enable_tcq) else 0 end"),
    flag("allow_parity_hiding", f"{LOSSY} and seq.enable_parity_hiding = 1 and allow_tcq = 0", 0),
    # deblocking: what the multi-frame header says, else flags for luma and, where one is set, for chroma
    Field("_mfh_deblock", "let", "cast(coalesce(mfh.mfh_deblocking_filter_update, 0) = 1 as int)", LOSSY),
    flag("_apply_0", f"{LOSSY} and _mfh_deblock = 0"),
    flag("_apply_1", f"{LOSSY} and _mfh_deblock = 0"),
    *[Field(f"apply_deblocking_filter_{i}", "let", f"coalesce(_apply_{i}, mfh.mfh_apply_deblocking_filter_{i})", LOSSY, 0) for i in (0, 1)],
    Field("_chroma", "let", "cast(seq.chroma_format_idc <> 1 and apply_deblocking_filter_0 + apply_deblocking_filter_1 > 0 as int)", LOSSY),
    flag("_apply_2", f"{LOSSY} and _mfh_deblock = 0 and _chroma = 1"),
    flag("_apply_3", f"{LOSSY} and _mfh_deblock = 0 and _chroma = 1"),
    *[Field(f"apply_deblocking_filter_{i}", "let", f"case when _chroma = 1 then coalesce(_apply_{i}, mfh.mfh_apply_deblocking_filter_{i}) else 0 end", LOSSY, 0) for i in (2, 3)],
    [
        f
        for i in range(4)
        for f in (
            flag(f"df_delta_q_present_{i}", f"apply_deblocking_filter_{i} = 1"),
            u(f"_df_{i}", "f", "seq.df_par_bits_minus_2 + 2", f"df_delta_q_present_{i} = 1"),
            # the second luma direction repeats the first where it names none
            Field(f"df_delta_q_{i}", "let", f"case when df_delta_q_present_{i} = 1 then _df_{i} - shiftleft(1, cast(seq.df_par_bits_minus_2 + 1 as int)) else {'df_delta_q_0' if i == 1 else '0'} end", f"apply_deblocking_filter_{i} = 1", 0),
        )
    ],
    flag("_gdf", f"{LOSSY} and seq.enable_gdf = 1 and seq.single_picture_header_flag = 0"),
    Field("gdf_frame_enable", "let", f"case when {LOSSY} and seq.enable_gdf = 1 then coalesce(_gdf, 1) else 0 end"),
    Field("_gdf_side", "let", f"case when seq.gdf_unit_matches_sb_size = 1 then 4 * shiftleft(1, cast({FRAME_SB_SHIFT} as int)) when {FRAME_SB_SHIFT} = 4 and odd_start = 1 then 64 else greatest({GDF_SIDE}, 4 * shiftleft(1, cast({FRAME_SB_SHIFT} as int))) end"),
    flag("gdf_per_block", "gdf_frame_enable = 1 and (greatest(mi_cols, mi_rows) * 4 > _gdf_side or (seq.disable_loopfilters_across_tiles = 1 and tile_cols * tile_rows > 1))"),
    u("gdf_pic_qc_idx", "f", 2, "gdf_frame_enable = 1"),
    u("gdf_pic_scale_idx", "f", 2, "gdf_frame_enable = 1"),
    flag("_cdef", f"{LOSSY} and seq.enable_cdef = 1 and seq.single_picture_header_flag = 0"),
    Field("cdef_frame_enable", "let", f"case when {LOSSY} and seq.enable_cdef = 1 then coalesce(_cdef, 1) else 0 end"),
    u("cdef_damping_minus_3", "f", 2, "cdef_frame_enable = 1"),
    u("cdef_strengths_minus_1", "f", 3, "cdef_frame_enable = 1"),
    flag("_cdef_skip", "cdef_frame_enable = 1 and seq.cdef_on_skip_txfm_always_on = 0 and seq.cdef_on_skip_txfm_disabled = 0"),
    Field("cdef_on_skip_txfm_frame_enable", "let", "coalesce(_cdef_skip, seq.cdef_on_skip_txfm_always_on)", "cdef_frame_enable = 1"),
    [f for k in range(8) for f in (*_strength(f"cdef_y_{k}", f"cdef_strengths_minus_1 >= {k}"), *_strength(f"cdef_uv_{k}", f"cdef_strengths_minus_1 >= {k} and seq.chroma_format_idc <> 1"))],
)


def odd_start(header: str = "header") -> Column:
    """1 where a tile of a frame header (with its tiles) begins at an odd superblock; spaced tiles begin at i * each + min(i, extra)."""
    h = F.col(header)
    own = F.concat(F.coalesce(h["own_cols_starts"], F.array().cast("array<bigint>")), F.coalesce(h["own_rows_starts"], F.array().cast("array<bigint>")))
    spaced = lambda n, each, extra: F.exists(F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1)) - 1), lambda i: (i * each + F.least(i, extra)) % 2 == 1)
    even = F.lit(False)
    for n, each, extra in (("tile_cols", "col_each", "col_extra"), ("tile_rows", "row_each", "row_extra")):
        even = even | F.coalesce(spaced(h[n], h[each], h[extra]), F.lit(False))
    return F.when(F.exists(own, lambda x: x % 2 == 1) | even, 1).otherwise(0)


def parsed_frames(df: DataFrame, data: str = "payload") -> DataFrame:
    """df (type_code, payload, seq, mfh) with header and, where the header is that of an intra frame read to its quantizers, filters."""
    first = FRAME.parsed(df, data)
    given = ["base_q_idx", "delta_q_y_dc", "delta_q_u_dc", "delta_q_v_dc", "delta_q_u_ac", "delta_q_v_ac", "mi_cols", "mi_rows", "tile_cols", "tile_rows"]
    context = first.select("*", *[F.col(f"header.{c}").alias(c) for c in given]).withColumn("odd_start", odd_start())
    read = FRAME_FILTERS.with_state(context, "_state", data, "coalesce(header_bits, 0)", when="header_error is null and base_q_idx is not null")
    there = F.col("base_q_idx").isNotNull() & F.col("header_error").isNull()
    return read.select(*first.columns, F.when(there, FRAME_FILTERS.named("_state")).alias("filters"), F.when(there, F.col("_state.error")).alias("filters_error"), F.when(there, F.col("_state.pos")).alias("filters_bits"))
