"""File, dataset and run names; durations and sizes as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Model aliases.
MODEL_ALIASES = {
    "llama3.2:3b": "meta-llama/Llama-3.2-3B-Instruct",
    "llama3.2:1b": "meta-llama/Llama-3.2-1B-Instruct",
    "llama3.1:8b": "meta-llama/Llama-3.1-8B-Instruct",
    "llama3:8b": "meta-llama/Meta-Llama-3-8B-Instruct",
    "mistral:7b": "mistralai/Mistral-7B-Instruct-v0.2",
    "mixtral:8x7b": "mistralai/Mixtral-8x7B-Instruct-v0.1",
    "phi3:mini": "microsoft/Phi-3-mini-4k-instruct",
    "gemma:7b": "google/gemma-7b-it",
    "gemma2:9b": "google/gemma-2-9b-it",
}
MODEL_ALIAS_DEFAULT = "meta-llama/Llama-3.2-3B-Instruct"

# Split names that end a dataset name in a file name.
SPLIT_NAMES = ("train", "test", "validation", "val")


def sanitize_name(c: Column) -> Column:
    """A directory name: forbidden characters to ``_``, no dots or spaces at
    either end, one ``_`` for a run of them, ``unnamed`` for nothing."""
    x = F.regexp_replace(c, r'[<>:"/\\|?*]', "_")
    x = F.regexp_replace(x, r"^[. ]+|[. ]+$", "")
    x = F.regexp_replace(x, "_+", "_")
    return F.when(x == "", "unnamed").otherwise(x)


def sanitize_project_name(c: Column) -> Column:
    """The form's variant: whitespace runs to ``-``, trailing dots dropped, lower case."""
    x = F.regexp_replace(c, r'[<>:"/\\|?*]', "_")
    x = F.regexp_replace(x, r"\s+", "-")
    x = F.trim(F.lower(F.regexp_replace(x, r"\.+$", "")))
    return F.when(x == "", "project").otherwise(x)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(name: Column) -> Column:
    """Name without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, or an empty string."""
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^.]*)$", 1))


def parse_dataset_filename(name: Column) -> Column:
    """Struct (author, name) from an import file name."""
    stem = file_stem(name)
    parts = F.split(F.substring(stem, F.lit(4), F.length(stem)), "_")
    first = F.array_position(F.transform(parts, lambda p: p.isin(*SPLIT_NAMES)), True)
    end = F.when(first > 1, first - 1).otherwise(F.size(parts).cast("long"))
    imported = stem.startswith("hf_") & (F.size(parts) >= 2)
    # A split name in first position does not count, even when another follows.
    author = F.when(imported, parts[0]).otherwise("user")
    dataset = F.when(imported, F.array_join(F.slice(parts, F.lit(2), (end - 1).cast("int")), "_")) \
        .when(stem.rlike("^[0-9a-fA-F]{32}$"), "unknown").otherwise(stem)
    return F.struct(author.alias("author"), dataset.alias("name"))


def split_repo_id(repo: Column, fallback_author: str = "huggingface", config: Column | None = None) -> Column:
    """Struct (author, name) at the first ``/``; a config is appended to the name."""
    has = repo.contains("/")
    author = F.when(has, F.substring_index(repo, "/", 1)).otherwise(fallback_author)
    name = F.when(has, F.regexp_replace(repo, "^[^/]*/", "")).otherwise(repo)
    if config is not None:
        name = F.when(config.isNotNull() & (config != ""), F.concat(name, F.lit("_"), config)).otherwise(name)
    return F.struct(author.alias("author"), name.alias("name"))


def display_name(name: Column, split: Column, config: Column) -> Column:
    base = F.concat(name, F.lit(" ("), split, F.lit(")"))
    return F.when(config.isNotNull() & (config != ""), F.concat(base, F.lit(" - "), config)).otherwise(base)


def map_alias(c: Column, aliases: dict[str, str] = MODEL_ALIASES, fallback: str | None = None) -> Column:
    """Look the name up in a fixed map; unknown names become ``fallback`` or stay as they are."""
    pairs = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), F.lit(fallback) if fallback is not None else c)


def format_duration(seconds: Column) -> Column:
    s = seconds.cast("long")
    hours, minutes = F.floor(s / 3600), F.floor(s / 60)
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))) \
        .when(s < 3600, F.concat(minutes.cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s"))) \
        .otherwise(F.concat(hours.cast("string"), F.lit("h "), F.floor((s % 3600) / 60).cast("string"), F.lit("m")))


def format_bytes(n: Column) -> Column:
    """``1.5 MB``: base 1024, at most two decimals, no trailing zeros."""
    units = ["Bytes", "KB", "MB", "GB", "TB"]
    out = F.lit("0 Bytes")
    for i, u in enumerate(units):
        scaled = F.format_string("%.2f", n.cast("double") / F.lit(float(1024 ** i)))
        text = F.concat(F.regexp_replace(scaled, r"\.?0+$", ""), F.lit(f" {u}"))
        out = F.when(n >= 1024 ** i, text).otherwise(out)
    return out
