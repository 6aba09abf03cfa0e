"""Deduplication jobs described by a configuration file or dict."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession

from corpusweave.operators.minhash import MinhashConfig, mark_duplicates
from corpusweave.operators.segmentation import fit_words, segmenter
from corpusweave.operators.sentences import SentenceConfig, sentence_dedup, sentence_signatures
from corpusweave.plans.staging import stage
from corpusweave.sources.registry import create_io_object, create_reader_and_writer


# Languages (ISO 639-3) that are written without blanks between words.
UNSPACED = ("zho", "cmn", "yue", "wuu", "jpn", "tha", "lao", "khm", "mya", "bod", "dzo")


def _is_unspaced(language: str | None) -> bool:
    return bool(language) and language.lower().split("_")[0] in UNSPACED


def _segment(docs: DataFrame, text_col: str, language: str | None) -> Callable[[Column], Column] | None:
    """What sets the words of the job's language apart, learned from the job's documents."""
    if not _is_unspaced(language):
        return None
    return segmenter(docs.sparkSession, fit_words(docs, text_col))


def load_config(config: str | dict[str, Any]) -> dict[str, Any]:
    """A dict as it is, or a YAML file; an empty configuration raises ``ValueError``."""
    if isinstance(config, str):
        import yaml

        with open(config, encoding="utf-8") as f:
            config = yaml.safe_load(f)
    if not config or not isinstance(config, dict):
        raise ValueError("the job configuration is empty or no mapping")
    return config


def run_minhash_job(spark: SparkSession, config: str | dict[str, Any]) -> None:
    """Read, remove near duplicates, write; removed rows go to the exclusion writer if any.

    Directories, logging and worker counts of the configuration are Spark's business here.
    Unknown options of ``hash_config`` and ``minhash_config`` raise.  In a ``language`` whose
    words are not set apart by blanks, words are found by a model of the documents.
    """
    cfg = load_config(config)
    hashing = dict(cfg.get("hash_config") or {})
    unknown = sorted(hashing.keys() - {"hash_fc", "precision"})
    if unknown:
        raise ValueError(f"unknown options of hash_config: {unknown}")
    options = MinhashConfig(**(cfg.get("minhash_config") or {}), **hashing)
    source, sink = create_reader_and_writer(spark, cfg)
    docs, columns = source.load()
    id_col, text_col = _keys(docs, source)
    segment = _segment(docs, text_col, cfg.get("language"))
    judged = mark_duplicates(docs, id_col, text_col, options, segment)
    if cfg.get("exclusion_writer"):
        # Both writers read it.
        judged = stage(judged, "judged")
    kept, removed = (judged.where(c).drop("is_duplicate") for c in ("not is_duplicate", "is_duplicate"))
    sink.save(kept, columns)
    if cfg.get("exclusion_writer"):
        use_adapter = cfg.get("use_column_info_adapter_for_exclusion_writer", False)
        excluded = create_io_object(spark, cfg["exclusion_writer"], "writer", use_adapter)
        excluded.save(removed, columns)


def run_sentence_job(
    spark: SparkSession, config: str | dict[str, Any], index: DataFrame | None = None
) -> None:
    """Read, remove repeated lines, write.  ``index`` holds ``id`` and ``text`` of a corpus
    whose lines are to be removed."""
    cfg = load_config(config)
    source, sink = create_reader_and_writer(spark, cfg)
    docs, columns = source.load()
    unspaced = {"unspaced": _is_unspaced(cfg.get("language"))}
    options = SentenceConfig(**(unspaced | (cfg.get("dedup_config") or {})))
    id_col, text_col = _keys(docs, source)
    listed = None if index is None else sentence_signatures(index, "id", "text", options)
    segment = _segment(docs, text_col, cfg.get("language"))
    sink.save(sentence_dedup(docs, id_col, text_col, listed, options, segment), columns)


def _keys(docs: DataFrame, source) -> tuple[str, str]:
    if source.use_adapter:
        return "id", "text"
    return source.id_key, source.text_key
