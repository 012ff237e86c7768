"""DataFrame operators: pooling over time, frame gathering, embedding tables."""

from framewright.operators.frames import chunk_plan, frame_gather, frame_plan, keep_decoded, sample_frames
from framewright.operators.pooling import first_token, mean_pool, weighted_mean_pool

__all__ = ["chunk_plan", "first_token", "frame_gather", "frame_plan", "keep_decoded", "mean_pool", "sample_frames", "weighted_mean_pool"]
