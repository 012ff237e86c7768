"""Column functions: sampling plans, vectors and text, all JVM-side."""

from framewright.functions.sampling import chunk_bounds, frame_indices, noise_profile_length, pad_last
from framewright.functions.text import preview, seconds_label, unicode_strip
from framewright.functions.vectors import l2_normalize, let, zero_vector

__all__ = ["chunk_bounds", "frame_indices", "l2_normalize", "let", "noise_profile_length", "pad_last", "preview", "seconds_label", "unicode_strip", "zero_vector"]
