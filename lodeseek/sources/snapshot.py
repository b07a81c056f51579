"""Versioned snapshots of the index: a run writes the parts it changes into a new directory and then flips a pointer, so a reader sees either state.

Every table is cut into parts by a hash of the file path. A pointer says for each table and part which snapshot holds it, so a changed file
rewrites its own part only. Pointers are numbered files, written under another name and renamed; the greatest counts, and none is ever
replaced. Snapshots of an older schema (whole tables, no parts) are read with the columns they lack as null; a newer schema is refused.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 5
#: The first schema that has parts, postings and statistics.
PARTED = 5
TABLES = {
    "files": "path string, content string, hash string, size long, language string, is_doc boolean, indexed_at timestamp",
    "symbols": "id string, file_path string, name string, qualified_name string, kind string, language string, signature string, line_start int, line_end int, char_start int, char_end int, parent_id string, doc_comment string, seq int",
    "sections": "id string, file_path string, title string, level int, parent_id string, byte_start int, byte_end int, char_start int, char_end int, summary string, seq int",
    "search_docs": "entity_id string, entity_type string, file_path string, name string, content string, length int",
    "postings": "term string, entity_id string, entity_type string, file_path string, pos int, length int",
    "stats": "entity_type string, docs long, words long",
    "vectors": "entity_id string, entity_type string, file_path string, embedding_text string, final_radius double, pq_angles binary, qjl_bits binary, pq_dimensions int, qjl_projected_dimensions int, model_id string",
}
#: Tables sorted inside their files: a search for a term skips the row groups that can't hold it.
SORTED = {"postings": ["term", "entity_id"]}
PART_BYTES, FEWEST_PARTS, MOST_PARTS = 1 << 27, 8, 4096


def columns(table: str) -> list[str]:
    return [c.split()[0] for c in TABLES[table].split(", ")]


def part_of(path: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(parts)).cast("int")


class SnapshotStore:
    """Tables under a folder that driver and executors share. The first run sets the number of parts: `parts`, or one for 128 MB of content."""

    def __init__(self, spark: SparkSession, folder: str, parts: int | None = None):
        self.spark, self.folder, self._wanted = spark, folder.rstrip("/"), parts

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []

    def _numbers(self) -> list[int]:
        return sorted(int(n[len("current-") : -len(".json")]) for n in self._names(self.folder) if re.fullmatch(r"current-\d+\.json", n))

    def _load(self, number: int) -> dict:
        fs, p = self._fs(f"{self.folder}/current-{number}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _pointer(self) -> dict | None:
        numbers = self._numbers()
        if not numbers:
            return None
        found = self._load(numbers[-1])
        if found["schema_version"] > SCHEMA_VERSION:
            raise ValueError(f"the index has schema {found['schema_version']}, this code reads up to {SCHEMA_VERSION}")
        return found

    @property
    def version(self) -> str | None:
        found = self._pointer()
        return found and found["snapshot"]

    @property
    def schema_version(self) -> int:
        found = self._pointer()
        return found["schema_version"] if found else SCHEMA_VERSION

    def parts_for(self, size: int) -> tuple[int, bool]:
        """The number of parts, and whether it is set now, so that a run has to write all of them. size: bytes of the contents."""
        found = self._pointer()
        if found and found["schema_version"] >= PARTED:
            return found["parts"], False
        return self._wanted or min(max(-(-size // PART_BYTES), FEWEST_PARTS), MOST_PARTS), True

    def read(self, table: str, parts: list[int] | None = None) -> DataFrame:
        """A table, or only some of its parts; a snapshot of an older schema is always read whole."""
        at = self._pointer()
        if at is not None and at["schema_version"] < PARTED:
            return self.spark.read.schema(TABLES[table]).parquet(f"{self.folder}/{at['snapshot']}/{table}")
        places = at["places"][table] if at else {}
        wanted = None if parts is None else {str(p) for p in parts}
        paths = [f"{self.folder}/{s}/{table}/part={p}" for p, s in places.items() if wanted is None or p in wanted]
        if not paths:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(*paths)

    def write(self, tables: dict[str, DataFrame], n_parts: int, changed: list[int] | None = None) -> str:
        """The rows of all tables in the changed parts (None: in all); the parts that aren't named stay where they are.

        Rows are dealt by part with a rebalance, which splits parts that are large and joins small ones. A table may bring its own `part`.
        """
        at, before = f"snapshot-{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}", self._pointer()
        gone = None if changed is None else {str(p) for p in changed}

        def save(name: str) -> dict[str, str]:
            df = tables[name]
            if "part" not in df.columns:
                df = df.withColumn("part", part_of(F.col("path" if name == "files" else "file_path"), n_parts))
            df = df.select("part", *columns(name)).hint("rebalance", "part")
            if name in SORTED:
                df = df.sortWithinPartitions("part", *SORTED[name])
            df.write.partitionBy("part").parquet(f"{self.folder}/{at}/{name}")
            old = {} if gone is None or not before else before["places"][name]
            new = [n[len("part=") :] for n in self._names(f"{self.folder}/{at}/{name}") if n.startswith("part=")]
            return {p: s for p, s in old.items() if p not in gone} | dict.fromkeys(new, at)

        with ThreadPoolExecutor(len(tables)) as pool:  # jobs of their own: small tables don't wait for large ones
            places = dict(zip(tables, pool.map(save, tables), strict=True))
        fs, tmp = self._fs(f"{self.folder}/.{at}.json")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps({"snapshot": at, "schema_version": SCHEMA_VERSION, "parts": n_parts, "places": places}).encode()))
        out.close()
        known = self._numbers()
        _, final = self._fs(f"{self.folder}/current-{(known or [0])[-1] + 1}.json")
        if not fs.rename(tmp, final):
            raise RuntimeError(f"another run has written {final}")
        for old in known[:-1]:  # the one before stays, for readers that have just read it
            fs.delete(self._fs(f"{self.folder}/current-{old}.json")[1], False)
        return at

    def vacuum(self, older_than_seconds: float = 7 * 24 * 3600) -> int:
        """Deletes the parts that no pointer names any more, of snapshots begun longer ago than that; returns how many."""
        kept = set()
        for pointer in map(self._load, self._numbers()):
            kept |= {(s, t, p) for t, of in pointer.get("places", {}).items() for p, s in of.items()}
            kept.add((pointer["snapshot"], None, None))
        limit, n = 1000 * (time.time() - older_than_seconds), 0
        for snapshot in self._names(self.folder):
            made = re.fullmatch(r"snapshot-(\d+)-\w+", snapshot)
            if not made or int(made[1]) > limit:
                continue
            for table in self._names(f"{self.folder}/{snapshot}"):
                for part in self._names(f"{self.folder}/{snapshot}/{table}"):
                    if part.startswith("part=") and (snapshot, table, part[len("part=") :]) not in kept:
                        fs, p = self._fs(f"{self.folder}/{snapshot}/{table}/{part}")
                        n += fs.delete(p, True)
        return n
