"""Media sources, model backends and embedding sinks."""

from framewright.sources.backends import Backend, MissingBackend, require
from framewright.sources.decoders import ContainerDecoder
from framewright.sources.files import write_files
from framewright.sources.media import list_media
from framewright.sources.mp4 import mp4_index, planned_packets, read_packets
from framewright.sources.npy import register_npy
from framewright.sources.sinks import export_npy, write_embeddings, write_transcripts
from framewright.sources.wave import wave_blocks, wave_blocks_of, wave_headers, write_waves

__all__ = [
    "Backend", "ContainerDecoder", "MissingBackend", "export_npy", "list_media", "mp4_index", "planned_packets", "read_packets", "register_npy", "require", "wave_blocks", "wave_blocks_of", "wave_headers", "write_embeddings",
    "write_files", "write_transcripts", "write_waves",
]
