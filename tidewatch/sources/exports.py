"""Flat exports, a file sink for notifications, backups."""

from __future__ import annotations

import zipfile
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Columns of a flat export, in order.
FLAT = (
    "shop_name shop_url review_id author stars time_text text profile_url avatar_path local_guide profile_review_count profile_photo_count photo_urls photo_paths "
    "owner_reply_text owner_reply_time first_seen_at updated_at back_calculated_at estimated_posted_date time_parse_status"
).split()
BOM = b"\xef\xbb\xbf"


def flat(reviews: DataFrame) -> DataFrame:
    """Nested reviews as the flat columns FLAT, arrays as JSON text; columns that `reviews` lacks are null."""
    nested = {
        "profile_url": F.col("profile.url"), "avatar_path": F.col("profile.avatar_path"), "local_guide": F.col("profile.local_guide"), "profile_review_count": F.col("profile.review_count"), "profile_photo_count": F.col("profile.photo_count"),
        "photo_urls": F.to_json(F.coalesce("photo_urls", F.array().cast("array<string>"))), "photo_paths": F.to_json(F.coalesce("photo_paths", F.array().cast("array<string>"))),
        "owner_reply_text": F.col("owner_reply.text"), "owner_reply_time": F.col("owner_reply.time_text"),
    }
    return reviews.select(*(nested.get(c, F.col(c) if c in reviews.columns else F.lit(None).cast("string")).alias(c) for c in FLAT))


def write_csv(df: DataFrame, folder: str) -> None:
    """CSV files with a header each."""
    df.write.option("header", True).option("escape", '"').csv(folder)


def with_bom(folder: str, file: str) -> int:
    """The CSV files of a local folder as one, with a byte order mark and one header; returns its size."""
    parts = sorted(Path(folder).glob("*.csv"))
    with open(file, "wb") as out:
        out.write(BOM)
        for i, part in enumerate(parts):
            with open(part, "rb") as f:
                if i:
                    f.readline()
                while piece := f.read(1 << 20):
                    out.write(piece)
        return out.tell()


def write_json(df: DataFrame, folder: str) -> None:
    df.write.json(folder)


class Sink(Protocol):
    """Takes a frame of due parts and returns (event_id, part_no) of those sent."""

    def send(self, parts: DataFrame) -> DataFrame: ...


class FileSink:
    """Appends parts to a folder; running it again for the same parts is harmless to their status."""

    def __init__(self, folder: str):
        self.folder = folder

    def send(self, parts: DataFrame) -> DataFrame:
        parts.write.mode("append").json(self.folder)
        return parts.select("event_id", "part_no")


def backup(folder: str, archive: str) -> list[str]:
    """All files under a local folder in a ZIP archive."""
    root = Path(folder)
    names = sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file())
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for name in names:
            z.write(root / name, name)
    return names


def restore(archive: str, folder: str, force: bool = False) -> list[str]:
    """Unpack a backup; existing files stop it unless forced, and no name may leave the folder."""
    root = Path(folder).resolve()
    with zipfile.ZipFile(archive) as z:
        for name in z.namelist():
            to = (root / name).resolve()
            if root not in to.parents:
                raise ValueError(f"{name} lies outside the folder")
            if to.exists() and not force:
                raise FileExistsError(str(to))
        z.extractall(root)
        return z.namelist()
