"""See ``functions.store``."""

from ..functions.store import bucketed, drop, new_path, release, shared_dir, stash, while_read

__all__ = ["bucketed", "drop", "new_path", "release", "shared_dir", "stash", "while_read"]
