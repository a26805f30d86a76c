"""Files that snapshots arrive in, and what is read from and written to files beside them."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.text import normalized

#: One card as a page shows it; the contract of the landing folder.
FRAGMENT = "id string, ord long, shop_key string, profile_url string, author string, avatar_url string, stars_label string, time_text string, review_text string, photo_urls array<string>, reply_text string, reply_time string, observed_at timestamp_ntz"
REVIEW = (
    "review_id string, shop_key string, shop_name string, shop_url string, author string, stars double, time_text string, text string, "
    "profile struct<url:string,avatar_url:string,avatar_path:string,local_guide:boolean,review_count:int,photo_count:int>, "
    "photo_urls array<string>, photo_paths array<string>, owner_reply struct<text:string,time_text:string>"
)
ASSET = "id string, shop_key string, published_at string, title string, body string, photos array<string>, videos array<string>"


def fragments(spark: SparkSession, folder: str, streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema(FRAGMENT).json(folder)


def complete_cards(df: DataFrame, limit: int) -> DataFrame:
    """The first `limit` cards of each shop that have stars and an author or a profile."""
    from pyspark.sql import Window

    full = df.filter((F.length("stars_label") > 0) & ((F.length("author") > 0) | (F.length("profile_url") > 0)))
    return full.withColumn("__n", F.row_number().over(Window.partitionBy("shop_key").orderBy("ord"))).filter(F.col("__n") <= limit).drop("__n")


def decoded(df: DataFrame, column: str = "snapshot_json") -> DataFrame:
    """Review documents stored as JSON text, with an explicit schema."""
    return df.withColumn("review", F.from_json(column, REVIEW)).drop(column)


@dataclass(frozen=True)
class Shop:
    name: str
    url: str
    enabled: bool = True


#: Lists of pauses in seconds, least and most.
PAUSES = {"shop_delay": (20.0, 45.0), "profile_delay": (4.0, 10.0), "scroll_delay": (1.5, 3.0), "telegram_send_delay": (3.0, 7.0)}


@dataclass(frozen=True)
class Settings:
    shops: tuple[Shop, ...]
    timezone: str = "Asia/Taipei"
    locale: str = "zh-TW"
    scan_limit: int = 50
    known_streak_stop: int = 10
    telegram_batch_limit: int = 15
    analysis_enabled: bool = True
    analysis_lexical_threshold: float = 0.85
    analysis_semantic_threshold: float = 0.92
    analysis_rules_path: str = "data/portal/review-analysis.yaml"
    data_dir: str = "data"
    log_dir: str = "logs"
    pauses: tuple[tuple[str, float, float], ...] = ()
    telegram_bot_token: str = ""
    telegram_chat_id: str = ""


def env_file(path: Path) -> dict[str, str]:
    """NAME=value lines of a file; blanks, comments and quotes aside. The process's own variables win."""
    out: dict[str, str] = {}
    for line in path.read_text(encoding="utf-8").splitlines() if path.exists() else ():
        name, equals, value = line.strip().removeprefix("export ").partition("=")
        if equals and not name.startswith("#"):
            out[name.strip()] = value.strip().strip("\"'")
    return out | dict(os.environ)


def load_settings(path: str, needs_token: bool = False) -> Settings:
    """TOML settings and the secrets of an .env file beside it; ranges are checked, disabled shops left out, folders relative to the file."""
    file = Path(path).resolve()
    raw = tomllib.loads(file.read_text(encoding="utf-8"))
    secrets = env_file(file.parent / ".env")
    known = {f for f in Settings.__dataclass_fields__ if f not in ("shops", "pauses", "telegram_bot_token", "telegram_chat_id")}
    values = {k: raw[k] for k in known if k in raw}
    for name in ("analysis_rules_path", "data_dir", "log_dir"):
        values[name] = str(file.parent / values.get(name, Settings.__dataclass_fields__[name].default))
    pauses = tuple((name, float(raw.get(f"{name}_min_seconds", low)), float(raw.get(f"{name}_max_seconds", high))) for name, (low, high) in PAUSES.items())
    shops = tuple(Shop(**x) for x in raw.get("shops", []) if x.get("enabled", True))
    token, chat = (secrets.get(x, "").strip() for x in ("TELEGRAM_BOT_TOKEN", "TELEGRAM_CHAT_ID"))
    out = Settings(shops=shops, pauses=pauses, telegram_bot_token=token, telegram_chat_id=chat, **values)
    if not 1 <= len(out.shops) <= 10:
        raise ValueError("1 to 10 enabled shops are needed")
    for shop in out.shops:
        parts = urlsplit(shop.url)
        if parts.scheme != "https" or "google." not in (parts.hostname or ""):
            raise ValueError(f"not a shop's address: {shop.url}")
    for name, low, high in (("scan_limit", 1, 200), ("known_streak_stop", 1, out.scan_limit), ("telegram_batch_limit", 1, 100), ("analysis_lexical_threshold", 0, 1), ("analysis_semantic_threshold", 0, 1)):
        if not low <= getattr(out, name) <= high:
            raise ValueError(f"{name} must lie in {low}..{high}")
    for name, low, high in out.pauses:
        if low < 0 or high < low:
            raise ValueError(f"{name}: 0 <= min <= max")
    if needs_token and not (token and chat):
        raise ValueError("TELEGRAM_BOT_TOKEN and TELEGRAM_CHAT_ID are needed")
    return out


def structured(path: str):
    """JSON, or YAML where a reader for it is installed."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def load_assets(spark: SparkSession, path: str) -> DataFrame:
    """Content assets, newest first by their date's text: a list, or one under `content`. Required fields and lists of strings are checked; a missing file has none."""
    raw = (structured(path) if Path(path).exists() else None) or []
    rows = raw.get("content", raw) if isinstance(raw, dict) else raw
    if not isinstance(rows, list) or not all(isinstance(x, dict) for x in rows):
        raise ValueError("content must be a list of objects")
    for row in rows:
        missing = [name for name in ("id", "shop_key", "published_at", "title", "body") if name not in row]
        if missing:
            raise ValueError(f"an asset lacks {', '.join(missing)}")
        for name in ("photos", "videos"):
            if not isinstance(row.get(name, []), list) or not all(isinstance(x, str) for x in row.get(name, [])):
                raise ValueError(f"{name} must be a list of strings")
    names = T.DataType.fromDDL(ASSET).names
    text = lambda row, n: row.get(n, []) if n in ("photos", "videos") else str(row[n])
    return spark.createDataFrame([tuple(text(row, n) for n in names) for row in rows], ASSET).orderBy(F.desc("published_at"))


RULES = {"exclude_reviews": "shop_key string, review_id string, reason string", "exclude_groups": "fingerprint string, reason string", "common_phrases": "text string, reason string"}


def load_rules(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Exclusions of reviews and groups, and common phrases, normalised, in their order; each needs a reason. A missing file has none."""
    raw = (structured(path) if Path(path).exists() else None) or {}
    out = {}
    for kind, schema in RULES.items():
        rows = raw.get(kind, [])
        if not isinstance(rows, list) or not all(isinstance(x, dict) and str(x.get("reason") or "").strip() for x in rows):
            raise ValueError(f"{kind} must be a list, and every rule in it needs a reason")
        names = T.DataType.fromDDL(schema).names
        if kind == "common_phrases":
            rows = [x for x in rows if str(x.get("text") or "").strip()]
        elif any(x.get(n) is None for x in rows for n in names):
            raise ValueError(f"a rule of {kind} lacks one of {', '.join(names)}")
        out[kind] = spark.createDataFrame([tuple(str(x[n]) for n in names) for x in rows], schema)
    phrases = out["common_phrases"]
    out["common_phrases"] = phrases.withColumn("text", normalized(F.col("text"))) if raw.get("common_phrases") else phrases
    return out
