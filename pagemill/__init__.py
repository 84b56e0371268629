"""pagemill: documents to retrieval-ready chunk tables, as Spark jobs.

``functions``  column expressions (row-local, no shuffle)
``operators``  DataFrame -> DataFrame transforms
``sources``    readers, writers and table adapters
``plans``      end-to-end jobs composed of the operators
``streaming``  the same work on Structured Streaming
"""

from pagemill.constants import ChunkingConfig
from pagemill.session import build_session

__all__ = ["ChunkingConfig", "build_session"]
