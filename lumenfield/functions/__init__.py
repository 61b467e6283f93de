"""Column functions on splat attributes: activations, colours, quantisers, rotations, packing, grids."""

from .activation import logit, log_scale, opacity_threshold, sigmoid, signed_log, signed_log_inverse, splat_importance
from .color import SH_C0, dc_to_display_u8, dc_to_linear, linear_to_dc, spz_color_u8
from .grid import distance, morton3, spatial_hash, voxel
from .quant import clip, fixed24, fixed24_decode, pack_10_11, pack_8888, round_even, sh_u8, spz_sh_u8, trunc_u8, unit_quantum, unpack_10_11
from .rotation import legacy_w, pack_2_10_10_10, pack_spz, sog_bytes, splat_bytes, unpack_2_10_10_10

__all__ = [n for n in dir() if not n.startswith("_")]
