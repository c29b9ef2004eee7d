"""Trees as a stream: files of Newick lines that arrive in a folder, turned into splits as they come."""

from cladeflow.streaming.splits import stream_splits

__all__ = ["stream_splits"]
