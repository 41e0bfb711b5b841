"""An archive of days whose batches are seen whole or not at all.

Rows lie in folders of their own for each commit, ``data/commit=<id>/<day>=...``, and are never overwritten. A version is a
small file, ``versions/<number>``, that says for each day which folder holds it. A commit writes the days that it touches to
a new folder, and then creates the next version's file, which only one writer can; another one that wanted the same number
starts again from the version that won. A run that dies before that leaves the archive as it was. Readers take the newest
version and read its folders alone.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import rows_added, upsert_keep_last


class Archive:
    def __init__(self, spark: SparkSession, path: str, day: str = "obs_date"):
        self.spark, self.path, self.day = spark, path.rstrip("/"), day

    def _files(self, path: str):
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> tuple[int, dict[str, str]]:
        """The newest version's number (0 without one) and its folder of each day."""
        place, fs = self._files(f"{self.path}/versions")
        names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
        newest = max((n for n in names if n.isdigit()), default=None)
        if newest is None:
            return 0, {}
        place, fs = self._files(f"{self.path}/versions/{newest}")
        stream = fs.open(place)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return int(newest), json.loads(text)

    def _publish(self, number: int, days: dict[str, str]) -> bool:
        """Creates the version's file; false if another writer has it. It is written aside first and then renamed, which
        fails where the name is taken, so that no reader sees half of it."""
        aside, fs = self._files(f"{self.path}/versions/.{uuid.uuid4().hex}")
        fs.mkdirs(aside.getParent())
        out = fs.create(aside, False)
        try:
            out.write(bytearray(json.dumps(days, sort_keys=True).encode()))
        finally:
            out.close()
        claim, _ = self._files(f"{self.path}/versions/.claim-{number:012d}")
        try:
            fs.create(claim, False).close()  # of several writers one creates it
        except Exception as e:
            if "exist" not in str(e):
                raise
            fs.delete(aside, False)
            return False
        return bool(fs.rename(aside, self._files(f"{self.path}/versions/{number:012d}")[0]))

    def read(self, schema, days: dict[str, str] | None = None) -> DataFrame:
        """The rows of a version's days, the newest version's by default; ``schema`` has the day column."""
        days = self.version()[1] if days is None else days
        if not days:
            return self.spark.createDataFrame([], schema)
        folders = [f"{self.path}/data/commit={commit}/{self.day}={day}" for day, commit in sorted(days.items())]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*folders).select(*schema.names)

    def commit(self, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> tuple[int, int]:
        """Upserts rows, the last of each key and day by ``order``, and gives the version made and the number of keys added.
        Rows without a day are refused, as no folder would hold them."""
        if new.filter(F.col(self.day).isNull()).limit(1).count():
            raise ValueError(f"rows without {self.day}")
        keys = [*keys, self.day] if self.day not in keys else list(keys)
        touched = [str(r[0]) for r in new.select(self.day).distinct().collect()]  # the days of one batch
        while True:
            number, days = self.version()
            old = self.read(new.schema, {d: c for d, c in days.items() if d in touched})
            added = rows_added(old, new, keys).first()[0]
            commit = uuid.uuid4().hex
            upsert_keep_last(old, new, keys, order).select(*new.columns).write.partitionBy(self.day).parquet(f"{self.path}/data/commit={commit}")
            # Another writer may have taken the number. Where it touched other days, this commit's folder still holds.
            while not self._publish(number + 1, days | dict.fromkeys(touched, commit)):
                seen = {d: days.get(d) for d in touched}
                number, days = self._after(number)
                if {d: days.get(d) for d in touched} != seen:
                    break
            else:
                return number + 1, added

    def _after(self, number: int) -> tuple[int, dict[str, str]]:
        """The newest version, once it is beyond ``number``: its writer has claimed it and is about to show it."""
        import time

        for _ in range(600):
            found = self.version()
            if found[0] > number:
                return found
            time.sleep(0.1)
        raise TimeoutError(f"version {number + 1} of {self.path} was claimed and not written; delete its claim to go on")
