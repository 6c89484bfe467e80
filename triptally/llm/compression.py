"""Compressed lengths of text windows under several dictionaries, the basis of two classifiers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HELD_OUT = 2  # rows with this remainder of crc32(doc_id) by 4 are never learned from

SAMPLE_TASKS = 32  # for a sample of some thousand whole texts


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def sample_by_class(
    rows: DataFrame, label: str, text: str, key: str, per_class: int, max_chars: int
) -> list[tuple]:
    """(label, passage) of about `per_class` rows of each class, chosen by a hash of key and text, so
    that rows without a key are drawn like others; the classes' sizes come first.

    A passage begins anywhere in its text, at a place chosen by the same hash, goes on at the text's
    beginning after its end, and has at most `max_chars` characters. Equal rows give one passage. This
    bounds what reaches the driver.
    """
    sizes = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not sizes:
        return []
    picked = _draw(rows, label, [key, text], sizes, per_class)
    length = F.greatest(F.length(text), F.lit(1))
    place = F.pmod(F.xxhash64(key, text, F.lit("place")), length).cast("int")
    turned = F.concat(F.substr(text, place + 1, F.lit(max_chars)), F.lit(" "), F.substring(text, 1, max_chars))
    own = F.least(length + 1, F.lit(max_chars))
    picked = picked.select(label, F.substr(turned, F.lit(1), own).alias(text)).distinct().collect()
    return sorted((r[0], r[1]) for r in picked)


def _draw(
    rows: DataFrame, label: str, by: Sequence[str], sizes: dict, per_class: int
) -> DataFrame:
    scale = 1 << 30
    shares = F.create_map(
        *[F.lit(x) for k, n in sizes.items() for x in (k, min(scale, scale * per_class // n + 1))]
    )
    return rows.where(F.pmod(F.xxhash64(*by), F.lit(scale)) < shares[F.col(label)])


def sample_by_label(
    docs: DataFrame, labels: DataFrame, label: str, text: str, key: str, per_class: int
) -> tuple[dict, DataFrame | None]:
    """The sizes of the classes of `labels`, and (key, label, text) of about `per_class` keys of each
    class, whole texts. Only the keys drawn are broadcast; no other text is shuffled. A key with
    several labels has the largest of them, one with several texts the first by order."""
    labels = labels.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias(label))
    sizes = {r[0]: r[1] for r in labels.groupBy(label).count().collect()}
    if not sizes:
        return sizes, None
    drawn = _draw(labels, label, [key], sizes, per_class)
    texts = docs.select(key, text).where(F.col(text).isNotNull())
    known = texts.join(F.broadcast(drawn), key)
    return sizes, known.repartition(SAMPLE_TASKS, key).groupBy(key, label).agg(F.min(text).alias(text))


def fast(min_match: int) -> zstandard.ZstdCompressionParameters:
    """The fast strategy with an acceleration above 0 stores literals as they are: a window's length
    then tells only how much of it the dictionary (or the window itself) holds."""
    return zstandard.ZstdCompressionParameters(
        window_log=16, hash_log=16, chain_log=14, search_log=1, min_match=min_match,
        target_length=1, strategy=zstandard.STRATEGY_FAST,
        write_content_size=0, write_checksum=0, write_dict_id=0,
    )


def thorough() -> zstandard.ZstdCompressionParameters:
    """Optimal parsing with matches from three bytes: slow, for the few texts that need it."""
    return zstandard.ZstdCompressionParameters(
        window_log=16, hash_log=16, chain_log=16, search_log=5, min_match=3, target_length=64,
        strategy=zstandard.STRATEGY_BTULTRA,
        write_content_size=0, write_checksum=0, write_dict_id=0,
    )


class Lengths:
    """Compressors of one raw-content dictionary each, made once per task."""

    def __init__(
        self, dictionaries: Sequence[bytes], window: int,
        params: zstandard.ZstdCompressionParameters,
    ):
        self.window = window
        self.compressors = [
            zstandard.ZstdCompressor(
                dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                compression_params=params,
            )
            for d in dictionaries
        ]

    def of(self, text: bytes) -> np.ndarray:
        """One row per window, one column per dictionary. The whole text is cut into windows."""
        size = self.window
        cut = [text[i : i + size] for i in range(0, len(text), size)] or [b""]
        columns = [[len(c.compress(w)) for w in cut] for c in self.compressors]
        return np.array(columns, np.int64).T
