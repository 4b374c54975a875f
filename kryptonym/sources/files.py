"""Files as a source and sink: masking and restoring folders of documents, key files, dictionaries."""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kryptonym.functions.columns import inner
from kryptonym.functions.dictionary import Entry, parse
from kryptonym.functions.rules import BY_ID
from kryptonym.operators.masker import Config, Masker, restore

from . import formats

KEY_PREFIX = "ключи_"
FILE_MASKED = "path string, out_path string, content binary, error string, keys array<struct<ord: int, placeholder: string, type_id: string, type: string, original: string>>"


def load_dictionary(path: str | Path) -> list[Entry]:
    """Entries of a dictionary file; none if it isn't there."""
    path = Path(path)
    return parse(path.read_text(encoding="utf-8").splitlines()) if path.exists() else []


def dictionary_table(spark: SparkSession, path: str) -> DataFrame:
    from kryptonym.functions.dictionary import parsed

    return parsed(spark.read.text(path))


def mask_files(files: DataFrame, config: Config | None = None) -> DataFrame:
    """files: path, content (as spark.read.format("binaryFile") gives). Each file numbers its values by itself.

    A file that fails gives its error's class and no content; the others go on.
    """
    settings = config or Config()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.path, batch.content):
                masker = Masker(settings)
                try:
                    made = formats.handler(path, formats.MASKED)(bytes(content), masker.mask)
                    rows.append((path, formats.masked_name(path), made, None, masker.keys))
                except (ValueError, RuntimeError) as e:
                    rows.append((path, None, None, f"{type(e).__name__}: {e}", []))
                except Exception as e:
                    rows.append((path, None, None, type(e).__name__, []))
            yield pd.DataFrame(rows, columns=["path", "out_path", "content", "error", "keys"])

    return files.select("path", "content").mapInPandas(run, FILE_MASKED)


def restore_files(files: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.path, batch.content):
                try:
                    made = formats.handler(path, formats.RESTORED)(bytes(content), lambda t: restore(t, keys))
                    rows.append((path, formats.restored_name(path), made, None))
                except Exception as e:
                    rows.append((path, None, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "out_path", "content", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, out_path string, content binary, error string")


def html_masked(df: DataFrame, html_col: str, config: Config | None = None) -> DataFrame:
    """Adds text_masked and keys: the page with its text nodes masked, numbered page by page."""
    settings = config or Config()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages in batches:
            out, keys = [], []
            for page in pages:
                masker = Masker(settings)
                try:
                    out.append(None if page is None else formats.change_html_text(page, masker.mask))
                except Exception as e:  # a parser's error may hold the page's text
                    raise RuntimeError(f"masking failed: {type(e).__name__}") from None
                keys.append(masker.keys)
            yield pd.DataFrame({"text": pd.Series(out, dtype=object), "keys": pd.Series(keys, dtype=object)})

    made = F.pandas_udf(run, "text string, keys array<struct<ord: int, placeholder: string, type_id: string, type: string, original: string>>")
    name = inner(df, "_m")[0]
    return df.withColumn(name, made(F.col(html_col))).select(*df.columns, F.col(name)["text"].alias("text_masked"), F.col(name)["keys"].alias("keys"))


def save_keys(keys: list[dict], folder: str | Path, now: datetime.datetime | None = None) -> Path | None:
    """The key file of a run; none without keys."""
    if not keys:
        return None
    now = now or datetime.datetime.now()
    path = Path(folder) / f"{KEY_PREFIX}{now:%Y%m%d_%H%M%S}.json"
    path.write_text(json.dumps({k["placeholder"]: {"original": k["original"], "type": k["type"]} for k in keys}, ensure_ascii=False, indent=2), encoding="utf-8")
    return path


def load_keys(path: str | Path) -> list[tuple[str, str]]:
    return [(p, v["original"]) for p, v in json.loads(Path(path).read_text(encoding="utf-8")).items()]


def keys_table(spark: SparkSession, path: str) -> DataFrame:
    """A key file as a table in its order: ord, placeholder, original, type."""
    return keys_parsed(spark.read.text(path, wholetext=True), "value")


def keys_parsed(files: DataFrame, column: str) -> DataFrame:
    """The keys of a column of key files' texts, with the other columns: ord, placeholder, original, type."""
    parsed = F.from_json(column, "map<string, struct<original: string, type: string>>")
    rest = [c for c in files.columns if c != column]
    return files.select(*rest, F.posexplode(F.map_entries(parsed)).alias("at", "e")).select(*rest, (F.col("at") + 1).alias("ord"), F.col("e.key").alias("placeholder"), F.col("e.value.original").alias("original"), F.col("e.value.type").alias("type"))


def newest_of(names: Column) -> Column:
    """The newest key file's name among a group's names, null without any: their names tell the time."""
    return F.max(F.when(names.startswith(KEY_PREFIX) & names.endswith(".json"), names))


def newest_keys(folder: str | Path) -> Path | None:
    return max(Path(folder).glob(f"{KEY_PREFIX}*.json"), key=lambda p: p.name, default=None)


def mask_paths(paths: list[str], config: Config | None = None) -> tuple[list[Path], list[str], dict[str, int], Path | None]:
    """The command line's run: all files share numbers. (outputs, errors, distinct values by label, key file)."""
    masker, made, errors = Masker(config or Config()), [], []
    for p in map(Path, paths):
        try:
            content = formats.handler(str(p), formats.MASKED)(p.read_bytes(), masker.mask)
            out = Path(formats.masked_name(str(p)))
            out.write_bytes(content)
            made.append(out)
        except Exception as e:
            errors.append(f"{p.name}: {e if isinstance(e, (ValueError, RuntimeError)) else type(e).__name__}")
    counts: dict[str, int] = {}
    for k in masker.keys:
        label = BY_ID[k["type_id"]].label if k["type_id"] in BY_ID else k["type_id"].upper()
        counts[label] = counts.get(label, 0) + 1
    return made, errors, counts, save_keys(masker.keys, Path(paths[0]).parent) if paths else None


def restore_paths(paths: list[str], keys_path: str | None = None) -> tuple[list[Path], list[str]]:
    found = Path(keys_path) if keys_path else newest_keys(Path(paths[0]).parent)
    if found is None or not found.exists():
        raise FileNotFoundError("no key file")
    keys, made, errors = load_keys(found), [], []
    for p in map(Path, paths):
        try:
            content = formats.handler(str(p), formats.RESTORED)(p.read_bytes(), lambda t: restore(t, keys))
            out = Path(formats.restored_name(str(p)))
            out.write_bytes(content)
            made.append(out)
        except Exception as e:
            errors.append(f"{p.name}: {e if isinstance(e, ValueError) else type(e).__name__}")
    return made, errors
