"""Language identification by compression: the language whose text helps most to compress a document is its own.

Case is folded. For each language a zstandard raw-content dictionary is cut from sampled training texts. A text is compressed with each
dictionary, quickly at first and again with more effort where the lead is narrow, and the smallest result wins; a lead
that is still small marks the answer as rejected.

The sample is bounded: sample_docs rows of each language, those with the lowest hashes of their ids, and dictionary_bytes
of their text. With the defaults that is all 256 texts where they are short, and about 96 where each has 1 KiB or more. Rows without text, language or id are no training rows. Everything else covers all rows and whole texts.
Predicting: null texts and texts without a letter give `und` with score 0; ties go to the first language by name.
Very long texts are compressed whole, one at a time. Repeated rows stay. Without any training row every answer is `und`. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import byte_slices, ship, unit_draw

SAMPLE_DOCS = 256
DICTIONARY_BYTES = 96 * 1024
MOST_LANGUAGES = 500


def learn(docs: DataFrame, training: Column, sample_docs: int = SAMPLE_DOCS, dictionary_bytes: int = DICTIONARY_BYTES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A dictionary of each language of the training rows; more than MOST_LANGUAGES are an error.

    Each language gives its sample_docs texts with the lowest draws, or all it has. Of each text the first bytes are
    used: an equal share of the dictionary, 1024 at least, so long texts fill it before the last of them.
    """
    rows = docs.filter(training & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & (F.length(text_col) > 0))
    draw = unit_draw(F.col(id_col), 10)
    # Draws come first without texts: the limit by row number holds within each input partition too.
    lowest = Window.partitionBy("lang").orderBy("draw")
    first = rows.select(F.col(lang_col).alias("lang"), draw.alias("draw")).withColumn("_r", F.row_number().over(lowest)).filter(F.col("_r") <= sample_docs)
    upto = first.groupBy("lang").agg(F.max("draw").alias("upto")).orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(upto) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    if not upto:
        return {}
    most = F.create_map(*[x for r in upto for x in (F.lit(r["lang"]), F.lit(r["upto"]))])
    drawn = rows.filter(draw <= F.element_at(most, F.col(lang_col))).select(F.col(lang_col).alias("lang"), F.left(F.col(text_col), F.lit(dictionary_bytes)).alias("text"), draw.alias("draw"))
    sample = drawn.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))).filter(F.col("_r") <= sample_docs)
    texts: dict[str, list[str]] = {}
    for r in sorted(sample.collect(), key=lambda r: (r["draw"], r["text"])):
        texts.setdefault(r["lang"], []).append(r["text"])
    # Each text gives an equal share of the dictionary, so that a long one does not fill it alone.
    return {lang: b"\n".join(t.lower().encode()[: max(1024, dictionary_bytes // len(ts))] for t in ts)[:dictionary_bytes] for lang, ts in sorted(texts.items())}


def predict(docs: DataFrame, dictionaries: dict[str, bytes], levels: tuple[int, int] = (1, 12), narrow: float = 0.06, margin: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) of every row.

    score is 0.5 to 1 for an answer: 1 - best / (best + second) over the compressed sizes. rejected: the best is not
    smaller than the second by the share margin, or there is no answer. Leads under the share narrow at the first of
    levels are decided at the second.
    """
    ship(docs.sparkSession)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packers: tuple[list, list] = ([], [])
        for level, held in zip(levels, packers, strict=True):
            for lang, data in dictionaries.items():
                raw = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                raw.precompute_compress(level=level)
                held.append((lang, zstandard.ZstdCompressor(dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False)))
        for batch in byte_slices(batches, 1):
            langs, scores, rejected = [], [], []
            for text in batch.column(1).to_pylist():
                if not dictionaries or not text or not any(map(str.isalpha, text)):
                    langs.append("und")
                    scores.append(0.0)
                    rejected.append(True)
                    continue
                data = text.lower().encode()
                for held in packers:
                    sizes = sorted((len(p.compress(data)), lang) for lang, p in held)
                    best, second = sizes[0][0], sizes[1][0] if len(sizes) > 1 else 2 * sizes[0][0]
                    if second - best >= narrow * second:
                        break
                langs.append(sizes[0][1])
                scores.append(second / (best + second))
                rejected.append(second - best < margin * second)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=[id_col, "lang_pred", "score", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).alias("_text")).mapInArrow(classify, f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean")
