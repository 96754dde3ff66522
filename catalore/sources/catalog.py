"""The catalogue's tables as DataFrames, with fixed schemas."""

from __future__ import annotations

from collections.abc import Callable, Collection
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMAS = {
    "items": "id bigint, sha256 string, md5 string, type string, size bigint, width bigint, height bigint, duration double, audio_tracks bigint, video_tracks bigint, subtitle_tracks bigint, time_added string, blurhash string, outro_kind string, content_end_ms bigint, video_codec string, audio_codec string",
    "files": "id bigint, sha256 string, item_id bigint, path string, filename string, last_modified string, scan_id bigint, available boolean",
    "setters": "id bigint, name string",
    "item_data": "id bigint, item_id bigint, job_id bigint, setter_id bigint, data_type string, idx bigint, source_id bigint, is_origin boolean, is_placeholder boolean",
    "extracted_text": "id bigint, language string, language_confidence double, confidence double, text string, text_length bigint",
    "embeddings": "id bigint, embedding array<float>",
    "embedding_quants": "id bigint, profile_id bigint, rev bigint, quant array<tinyint>",
    "tags": "id bigint, namespace string, name string, item_count bigint",
    "tags_items": "item_data_id bigint, tag_id bigint, item_id bigint, confidence double",
    "folders": "id bigint, time_added string, path string, included boolean",
    "file_scans": "id bigint, start_time string, end_time string, path string, total_available bigint, new_items bigint, unchanged_files bigint, new_files bigint, modified_files bigint, marked_unavailable bigint, errors bigint, false_changes bigint, metadata_time double, hashing_time double, thumbgen_time double, blurhash_time double",
    "data_jobs": "id bigint, completed int",
    "data_log": "id bigint, job_id bigint, start_time string, end_time string, type string, setter string, threshold double, batch_size bigint, image_files bigint, video_files bigint, other_files bigint, total_segments bigint, errors bigint, input_errors bigint, total_remaining bigint, data_load_time double, inference_time double, completed boolean",
    "item_extraction_errors": "id bigint, item_id bigint, setter_id bigint, stage string, error_class string, blocker string, mime_type string, error string, skip_after bigint, attempts bigint, last_job_id bigint, first_seen string, last_seen string",
    "scan_errors": "id bigint, path string, last_modified string, file_size bigint, stage string, error_class string, blocker string, mime_type string, error string, skip_after bigint, attempts bigint, last_scan_id bigint, first_seen string, last_seen string",
    "vector_quant_profiles": "id bigint, name string, quantizer string, options string, state string, is_default boolean",
    "vector_quant_coverage": "profile_id bigint, setter_id bigint, needs_artifact boolean, artifact double, artifact_rev bigint, n_at_artifact bigint, dim bigint, metric string, state string",
    "bookmarks": "user string, namespace string, sha256 string, time_added string, metadata string",
    "pinboards": "id bigint, user string, name string, head_version_id bigint, time_added string, time_updated string, flags string, last_seen bigint, frecency double, frecency_at bigint",
    "pinboard_versions": "id bigint, pinboard_id bigint, layout string, name_at_save string, preview binary, preview_w bigint, preview_h bigint, screenful_h bigint, time_added string",
    "pinboard_version_items": "version_id bigint, sha256 string",
    "pinboard_databases": "pinboard_id bigint, db_uuid string, db_name string, instance_uuid string, last_stamped bigint",
    "visual_attempts": "item_sha256 string, kind string, item_mime_type string, version bigint, outcome string, blocker string, skip_after bigint, attempts bigint, last_scan_id bigint, error string, first_seen string, last_attempt string",
}

#: Parquet names under which a table may lie besides its own.
ALIASES = {"embeddings": "vector_fixtures"}


class Catalog:
    """Tables by name: given ones first (a DataFrame, or what makes it when asked for), then parquet under ``folder``.

    Without a folder a table that is not given is empty. With one, only the
    tables named in ``absent`` are; any other that can't be read, or lacks a
    column, raises, so that a wrong path never looks like an empty library.

    Keys are kept unique by what writes the tables; a row that is recorded twice
    all the same counts twice, and no read pays for looking.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, tables: dict[str, DataFrame | Callable[[], DataFrame]] | None = None, absent: Collection[str] = ()):
        self.spark, self.folder, self.absent = spark, folder, frozenset(absent)
        if unknown := self.absent - set(SCHEMAS):
            raise ValueError(f"no such tables: {sorted(unknown)}")
        self._tables = dict(tables or {})
        #: Full-text indexes by the table they were made from; such a table is searched by scanning it where there is none.
        self.text_indexes: dict = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self._read(name)
        elif not isinstance(self._tables[name], DataFrame):
            self._tables[name] = self._tables[name]()
        return self._tables[name]

    def _read(self, name: str) -> DataFrame:
        if not self.folder or name in self.absent:
            return self.spark.createDataFrame([], SCHEMAS[name])
        columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        return self.spark.read.parquet(f"{self.folder}/{ALIASES.get(name, name)}.parquet").select(*columns)

    def but(self, **tables: DataFrame) -> "Catalog":
        """A copy with some tables replaced."""
        out = Catalog(self.spark, self.folder, self._tables | tables, self.absent)
        out.text_indexes = {k: v for k, v in self.text_indexes.items() if k not in tables}
        return out

    def indexed(self, **indexes) -> "Catalog":
        """A copy with full-text indexes of some tables."""
        out = self.but()
        out.text_indexes |= indexes
        return out

    @cached_property
    def texts(self) -> DataFrame:
        """(data_id, item_id, setter_id, ..., text): extracted texts with their lineage."""
        made = self["item_data"].where("data_type = 'text'").select(F.col("id").alias("data_id"), "item_id", "setter_id", "idx", "source_id", "job_id")
        return self["extracted_text"].withColumnRenamed("id", "data_id").join(made, "data_id")

    def save(self, folder: str, *names: str) -> None:
        """Write tables as parquet; a table that is read from ``folder`` itself is computed before it is replaced."""
        from catalore.plans.runtime import cut_lineage

        for name in names:
            df = self[name]
            if folder == self.folder:
                df = cut_lineage(df)
            df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
