"""Directory listing that runs inside tasks."""

from itertools import islice

import sys

import pandas as pd
from pyspark import cloudpickle

# Executors need no copy of this package: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


FRAME_ROWS = 10_000


def list_level(batches):
    """Entries of each directory, one level deep, in frames of bounded size."""
    from pyarrow import fs

    for batch in batches:
        for directory in batch["path"]:
            if ":" in directory:
                system, inner = fs.FileSystem.from_uri(directory.replace("s3a:", "s3:", 1))
            else:
                system, inner = fs.LocalFileSystem(), directory
            prefix = directory[: len(directory) - len(inner)]
            entries = iter(system.get_file_info(fs.FileSelector(inner)))
            while part := list(islice(entries, FRAME_ROWS)):
                dirs = [e.type == fs.FileType.Directory for e in part]
                yield pd.DataFrame(
                    {
                        "path": [prefix + e.path for e in part],
                        "is_dir": dirs,
                        "bytes": [0 if d else e.size for d, e in zip(dirs, part, strict=True)],
                    }
                )
