"""One file per key, in a folder that all executors share; and messages of a topic."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.targets.base import WRITES, Capabilities


def inside(root: str, name: str) -> Path:
    """The path of `name` below `root`; an error if it is elsewhere."""
    top = Path(root).resolve()
    path = (top / name).resolve()
    if path == top or top not in path.parents:
        raise ValueError(f"{name!r} leaves the folder")
    return path


class DirTarget:
    """Files by relative name (`key`) with `content` (binary or text). A file is written beside its place and moved there, so that readers see all of it or the old one."""

    capabilities = Capabilities(idempotent=True)
    keys, values = ["key"], ["content"]

    def __init__(self, root: str):
        self.root = root.removeprefix("file://")

    def prepare(self) -> None:
        os.makedirs(self.root, exist_ok=True)

    def apply(self, actions: DataFrame) -> None:
        root = self.root

        def write(rows: Iterator) -> None:
            for r in rows:
                path = inside(root, r["key"])
                if r["action"] == "delete":
                    path.unlink(missing_ok=True)
                    for folder in path.parents:  # empty folders go with their last file
                        if folder == Path(root).resolve() or any(folder.iterdir()):
                            break
                        folder.rmdir()
                elif r["action"] in WRITES:
                    path.parent.mkdir(parents=True, exist_ok=True)
                    new = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
                    data = r["content"]
                    new.write_bytes(data.encode() if isinstance(data, str) else bytes(data))
                    os.replace(new, path)

        actions.where("action not in ('none', 'unchanged')").foreachPartition(write)

    def drop(self) -> None:
        import shutil

        shutil.rmtree(self.root, ignore_errors=True)


def topic_messages(actions: DataFrame, key: str, value: str, deletion: Column | None = None) -> DataFrame:
    """(key, value) to send: what changed, and for deletions a null value or `deletion`."""
    sent = actions.where("action not in ('none', 'unchanged')")
    gone = F.lit(None).cast("string") if deletion is None else deletion
    return sent.select(F.col(key).cast("string").alias("key"), F.when(F.col("action") == "delete", gone).otherwise(F.col(value).cast("string")).alias("value"))


class TopicTarget:
    """A topic of a broker that Spark writes to (kafka), or any writer of (key, value) frames."""

    capabilities = Capabilities(idempotent=False, ordered=True)
    keys, values = ["key"], ["value"]

    def __init__(self, topic: str, servers: str | None = None, deletion: Column | None = None, writer: Callable[[DataFrame], None] | None = None):
        self.topic, self.servers, self.deletion, self.writer = topic, servers, deletion, writer

    def prepare(self) -> None: ...

    def apply(self, actions: DataFrame) -> None:
        messages = topic_messages(actions, "key", "value", self.deletion)
        if self.writer:
            self.writer(messages)
        else:
            messages.write.format("kafka").option("kafka.bootstrap.servers", self.servers).option("topic", self.topic).save()

    def drop(self) -> None: ...
