from .cache import newest, prune, publish, read_canonical, snapshots, write_canonical
from .listings import canonicalize, conform, load_listings, missing_columns, read_raw
from .staging import stage

__all__ = [
    "canonicalize",
    "conform",
    "load_listings",
    "missing_columns",
    "newest",
    "prune",
    "publish",
    "read_canonical",
    "read_raw",
    "snapshots",
    "stage",
    "write_canonical",
]
