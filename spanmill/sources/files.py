"""Small files and byte ranges, on local paths or any store that Arrow opens."""

from __future__ import annotations

import json
import tempfile


def _store(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def opened(path: str):
    store, at = _store(path)
    return store.open_input_file(at)


def exists(path: str) -> bool:
    from pyarrow import fs

    store, at = _store(path)
    return store.get_file_info(at).type != fs.FileType.NotFound


def read_text(path: str) -> str:
    with opened(path) as f:
        return f.read().decode()


def write_text(path: str, value: str) -> None:
    store, at = _store(path)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    with store.open_output_stream(at) as f:
        f.write(value.encode())


def read_json(path: str):
    return json.loads(read_text(path))


def write_json(path: str, value) -> None:
    write_text(path, json.dumps(value, indent=2))


def remove(spark, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one where it is unset on a local master."""
    root, master = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir(), spark.sparkContext.master
    if not root and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return root or f"file://{tempfile.gettempdir()}"


def checkpoint_folder(spark) -> None:
    """Let the session write checkpoints below the shared folder, unless it does already."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def settled(df):
    """``df`` written once to the shared folder, without its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
