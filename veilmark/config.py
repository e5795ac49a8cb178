"""Settings of a session: keys of the Spark configuration below `veilmark.`, each with a default."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

VERSION = "1.0.0"
#: The only kind of file that is read and written.
EXTENSIONS = (".docx",)


@dataclass(frozen=True)
class Settings:
    app_name: str = "Veilmark"
    app_env: str = "development"
    log_level: str = "INFO"
    max_upload_size_mb: int = 20
    download_ttl_seconds: int = 600
    default_phone_region: str = "IN"

    @property
    def debug(self) -> bool:
        return self.app_env.lower() != "production"

    @property
    def max_bytes(self) -> int:
        return self.max_upload_size_mb * 1024 * 1024


def settings(spark: SparkSession) -> Settings:
    """The session's settings; numbers are read as such."""
    given = {f.name: spark.conf.get(f"veilmark.{f.name}", None) for f in fields(Settings)}
    return Settings(**{f.name: type(f.default)(given[f.name]) for f in fields(Settings) if given[f.name] is not None})
