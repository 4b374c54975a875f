"""The service surface over tables of requests: validation, size limit, masking, restoring, readiness, counters.

No result or error carries a rejected request's content: errors are a status and the names of fields.
"""

from __future__ import annotations

import hashlib
import hmac
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from kryptonym.functions.columns import inner
from kryptonym.functions.layers import NatashaTagger, PymorphyMorphology

from .mask import masked_column, restored
from .masker import Config

# The limit of a body and the shapes of the requests.
MAX_BODY = 256 * 1024
VERSION = "1.0.0"
LEAST_TOKEN = 16
MASK_FIELDS = {"text": "string", "use_ner": "boolean", "use_dict": "boolean"}
RESTORE_FIELDS = {"text": "string", "keys": "object"}
MOST_ERRORS = 10
KEYS = "map<string, struct<original: string, type: string>>"


def check_settings(token: str | None, max_body: int | str = MAX_BODY) -> tuple[bytes, int]:
    """A service without a token or with a senseless limit does not start."""
    if not (token or "").strip():
        raise RuntimeError("a token is required")
    try:
        limit = int(max_body)
    except ValueError:
        raise RuntimeError("the body limit must be a number of bytes") from None
    if limit <= 0:
        raise RuntimeError("the body limit must be above zero")
    return token.strip().encode(), limit


def authorised(header: str | None, token: bytes) -> bool:
    scheme, _, value = (header or "").partition(" ")
    return scheme.lower() == "bearer" and hmac.compare_digest(value.strip().encode("utf-8"), token)


def authorised_column(header: Column, token: str) -> Column:
    """The same for a column of headers; null is none."""
    scheme, value = F.lower(F.split_part(header, F.lit(" "), F.lit(1))), F.trim(F.regexp_replace(header, r"^\S*\s?", ""))
    return F.coalesce((scheme == "bearer") & (F.sha2(value.cast("binary"), 256) == hashlib.sha256(token.encode()).hexdigest()), F.lit(False))


def field_errors(body: Column, fields: dict[str, str], required: tuple[str, ...] = ("text",), keys_checked: bool = False) -> Column:
    """`field: kind of error` of each field that is missing, of another type or unknown; the first MOST_ERRORS.

    `body` is a variant; a variant's schema tells its type without its value.
    """
    found = []
    types = {"string": "STRING", "boolean": "BOOLEAN", "object": "OBJECT<"}
    for name, kind in fields.items():
        value = F.try_variant_get(body, f"$.{name}", "variant")
        is_kind = F.startswith(F.schema_of_variant(value), F.lit(types[kind]))
        missing = F.lit(f"{name}: missing") if name in required else F.lit(None)
        found.append(F.when(value.isNull(), missing).when(~is_kind, F.lit(f"{name}: {kind}_type")))
    present = F.map_keys(F.coalesce(F.try_variant_get(body, "$", "map<string, variant>"), F.create_map().cast("map<string, variant>")))
    extra = F.transform(F.array_except(present, F.array(*(F.lit(f) for f in fields))), lambda f: F.concat(f, F.lit(": extra_forbidden")))
    return F.slice(F.concat(F.filter(F.array(*found), lambda e: e.isNotNull()), extra), 1, MOST_ERRORS)


def validated(requests: DataFrame, body_col: str = "body", fields: dict[str, str] | None = None, limit: int = MAX_BODY) -> DataFrame:
    """Adds status (200, 413, 400, 422) and errors (array). Too large bodies are not parsed."""
    size = F.octet_length(F.coalesce(F.col(body_col), F.lit("")))
    parsed = F.when(size <= limit, F.try_parse_json(body_col))
    body = inner(requests, "_body")[0]
    out = requests.withColumn(body, parsed)
    is_object = F.startswith(F.schema_of_variant(body), F.lit("OBJECT<"))
    errors = F.when(is_object, field_errors(F.col(body), fields or MASK_FIELDS)).otherwise(F.array().cast("array<string>"))
    out = out.withColumn("errors", errors)
    status = F.when(size > limit, 413).when(F.col(body).isNull(), 400).when(~is_object | (F.size("errors") > 0), 422).otherwise(200)
    return out.withColumn("status", status).drop(body)


def anonymize(requests: DataFrame, config: Config, body_col: str = "body", limit: int = MAX_BODY) -> DataFrame:
    """Answers of masking requests: status, errors, text, keys (map), total and by_type.

    A request that wants the tagger while it or the morphology is not there gets 503, never text masked by less. Each
    request numbers its values by itself. use_ner stands for the tagger and the morphology together.
    """
    checked = validated(requests, body_col, MASK_FIELDS, limit)
    got, ner, words, made = inner(checked, "_r", "_ner", "_dict", "_m")
    parsed = F.from_json(F.when(F.col("status") == 200, F.col(body_col)), "text string, use_ner boolean, use_dict boolean")
    checked = checked.withColumn(got, parsed).withColumn(ner, F.coalesce(F.col(got)["use_ner"], F.lit(True))).withColumn(words, F.coalesce(F.col(got)["use_dict"], F.lit(True)))
    if not config.ready:
        checked = checked.withColumn("status", F.when((F.col("status") == 200) & F.col(ner), 503).otherwise(F.col("status")))
    parts = []
    for use_ner in (True, False):
        for use_dict in (True, False):
            own = Config(config.enabled, config.dictionary if use_dict else (), config.tagger if use_ner else None, config.morphology if use_ner else None)
            rows = checked.where((F.col("status") == 200) & (F.col(ner) == use_ner) & (F.col(words) == use_dict))
            parts.append(rows.withColumn(made, masked_column(F.col(got)["text"], own)))
    empty = F.lit(None).cast("struct<text: string, keys: array<struct<ord: int, placeholder: string, type_id: string, type: string, original: string>>>")
    parts.append(checked.where("status <> 200").withColumn(made, empty))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    found = F.col(made)["keys"]
    keys = F.map_from_entries(F.transform(found, lambda k: F.struct(k["placeholder"], F.struct(k["original"].alias("original"), k["type"].alias("type")))))
    ids = F.array_distinct(F.transform(found, lambda k: k["type_id"]))
    counts = F.map_from_entries(F.transform(ids, lambda t: F.struct(t, F.size(F.filter(found, lambda k: k["type_id"] == t)))))
    rest = [c for c in requests.columns if c != body_col]
    return out.select(*rest, "status", "errors", F.col(made)["text"].alias("text"), keys.alias("keys"), F.size(found).alias("total"), counts.alias("by_type"))


def restore_requests(requests: DataFrame, body_col: str = "body", limit: int = MAX_BODY) -> DataFrame:
    checked = validated(requests, body_col, RESTORE_FIELDS, limit)
    got = F.from_json(F.when(F.col("status") == 200, F.col(body_col)), f"text string, keys {KEYS}")
    entries = F.transform(F.map_entries(F.coalesce(got["keys"], F.create_map().cast(KEYS))), lambda e: F.struct(e["key"].alias("placeholder"), e["value"]["original"].alias("original")))
    rest = [c for c in requests.columns if c != body_col]
    bad = F.exists(entries, lambda e: e["original"].isNull())
    status = F.when((F.col("status") == 200) & bad, 422).otherwise(F.col("status"))
    return checked.select(*rest, status.alias("status"), "errors", F.when(status == 200, restored(got["text"], entries)).alias("text"))


def build_layers(dictionary: tuple = ()) -> tuple[Config, dict[str, str]]:
    """(configuration, status of each layer). A missing layer is a status, not an error."""
    status, made = {}, {}
    for name, kind in (("ner", NatashaTagger), ("surnames", PymorphyMorphology)):
        try:
            made[name] = kind().load()
            status[name] = "on"
        except ImportError:
            status[name] = "not installed"
        except Exception as e:
            status[name] = f"failed: {type(e).__name__}"
    status["dictionary"] = f"{len(dictionary)} entries" if dictionary else "empty"
    return Config(dictionary=dictionary, tagger=made.get("ner"), morphology=made.get("surnames")), status


def fingerprint() -> str:
    """12 hex digits that change with the masking code and its rules."""
    here = Path(__file__).parent
    files = [here / "masker.py", *sorted((here.parent / "functions").glob("*.py"))]
    return hashlib.sha256(b"".join(p.read_bytes() for p in files)).hexdigest()[:12]


def health(config: Config, status: dict[str, str]) -> dict[str, object]:
    return {"code": 200 if config.ready else 503, "status": "ok" if config.ready else "degraded", "ready": config.ready, **{f"{k}_status": v for k, v in status.items()}, "version": VERSION, "fingerprint": fingerprint()}


def observed(answers: DataFrame, name: str = "anonymize") -> tuple[DataFrame, Observation]:
    """The answers with counters only: requests, characters, masks. Read them after an action."""
    seen = Observation(name)
    return answers.observe(seen, F.count("*").alias("requests"), F.sum(F.length("text")).alias("chars"), F.sum("total").alias("masks"), F.count_if(F.col("status") != 200).alias("refused")), seen


def counted(answers: DataFrame) -> DataFrame:
    """The same counters as a row."""
    return answers.agg(F.count("*").alias("requests"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.coalesce(F.sum(F.when(F.col("status") == 200, F.col("total"))), F.lit(0)).cast("long").alias("masks"), F.count_if(F.col("status") != 200).alias("refused"))
