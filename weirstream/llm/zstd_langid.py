"""Language identification by compression: each language has a raw-content zstandard dictionary.

A text is cut into blocks, every block is compressed with each dictionary, and the language whose
dictionary gives the fewest bytes over all blocks is chosen. Where the runner-up is too close, the
answer is marked as not accepted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirstream.llm.common import output_schema, slices, with_columns

#: The bounded labelled sample: so many documents of each language, so many characters of each at most.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 256, 500, 112_000
#: Languages with a dictionary: the most frequent labels. Texts of rarer ones get the nearest of these.
MAX_LANGUAGES = 256
BLOCK_BYTES = 4_096
#: Accepted if the best size is smaller than the second by this share; the score is 1 from FULL_MARGIN on.
MIN_MARGIN, FULL_MARGIN = 0.004, 0.10
LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: str) -> Column:
    """Documents of this fold are never learned from."""
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def learn_dictionaries(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, dictionary_bytes: int = DICTIONARY_BYTES, max_languages: int = MAX_LANGUAGES) -> dict[str, bytes]:
    """Dictionary content by language, most frequent language first, from a hash sample of the learning fold.

    Documents fall into ``sample_docs`` buckets by a hash of their text (so copies share a bucket) and each
    bucket gives the one with the smallest hash: one map-side combined aggregation, whatever share of the
    rows a language has. The driver gets at most ``max_languages`` * sample_docs * sample_chars characters. Labels
    beyond the ``max_languages`` most frequent ones (of equal counts the first by name) have no dictionary.
    """
    labelled = docs.where(F.col(lang).isNotNull() & (F.length(text) > 0) & ~F.coalesce(held_out(doc_id), F.lit(False)))
    hashed = F.xxhash64(F.col(text))
    drawn = (
        labelled.select(F.col(lang).cast("string").alias("lang"), F.substring(F.col(text), 1, sample_chars).alias("sample"), hashed.alias("h"))
        .groupBy("lang", F.pmod("h", F.lit(sample_docs)).alias("bucket"))
        .agg(F.min_by("sample", F.struct("h", "sample")).alias("sample"))
    )
    labels = labelled.groupBy(F.col(lang).cast("string").alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages)
    texts: dict[str, list[str]] = {r.lang: [] for r in labels.collect()}
    for r in drawn.where(F.col("lang").isin(list(texts))).orderBy("lang", "bucket").collect():
        texts[r.lang].append(r.sample)
    return {k: "\n".join(v).encode()[:dictionary_bytes] for k, v in texts.items()}


def sizes(raw: bytes, compressors: list, block: int) -> list[int]:
    """Compressed bytes of all blocks by compressor."""
    if len(raw) <= block:
        return [len(c.compress(raw)) for c in compressors]
    parts = [raw[i : i + block] for i in range(0, len(raw), block)]
    return [sum([len(c.compress(p)) for p in parts]) for c in compressors]


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", keep: list[str] | None = None, level: int = 6, block: int = BLOCK_BYTES, min_margin: float = MIN_MARGIN) -> DataFrame:
    """Language of each whole text, map-only, from the text alone.

    Returns the ``keep`` columns (default ``doc_id``) with lang_pred, score (0 to 1: the margin between the
    two smallest sizes, scaled), margin (share of the second size) and accepted. A text that is null or has
    no letter, or any text if no language was learned, is ``und`` with score 0 and not accepted. With one
    language learned the margin is 1. Equal sizes go to the earlier language (the more frequent one), with margin 0.
    Repeated rows repeat; an empty table gives an empty result; other columns are not read.
    """
    keep = keep or ["doc_id"]
    names = list(dictionaries)
    shared = docs.sparkSession.sparkContext.broadcast([dictionaries[k] for k in names])
    new = {"lang_pred": "string", "score": "double", "margin": "double", "accepted": "boolean"}

    def run(batches):
        import zstandard

        compressors = []
        for content in shared.value:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            compressors.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False))
        for batch in batches:
            for start, length, texts in slices(batch, text):
                lang, margin = [], np.zeros(length)
                for i, t in enumerate(texts):
                    if not compressors or not t or not LETTER.search(t):
                        lang.append("und")
                        continue
                    found = sizes(t.encode(), compressors, block)
                    order = sorted(range(len(found)), key=found.__getitem__)
                    lang.append(names[order[0]])
                    margin[i] = 1 - found[order[0]] / found[order[1]] if len(order) > 1 else 1.0
                known = np.array([x != "und" for x in lang], bool)
                out = {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(np.minimum(1.0, margin / FULL_MARGIN)), "margin": pa.array(margin), "accepted": pa.array(known & (margin >= min_margin))}
                yield with_columns(batch, keep, start, length, out)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, output_schema(docs, keep, new))
