"""Articles to lemmas.

Word lists are sent to every executor, and an article's words are looked up
inside its own row: there is no shuffle, whatever the length of the lists up
to ``MOST_FORMS``. Longer ones are joined with the different words of blocks
of articles, never with single occurrences.
"""

from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeloom.functions import tokens
from themeloom.operators.batches import AT_ONCE, in_pieces
from themeloom.plans.staging import staged
from themeloom.sources.word_lists import IRREGULAR_LEMMAS

# Longest list that is sent to every executor, and the longest of its words in characters.
MOST_FORMS = 2_000_000
LONGEST_FORM = 100

# Stop words of a longer list are copied this often, to split frequent lemmas.
SALTS = 16

# Bytes of the words of a block of articles that are joined with a longer list.
BLOCK_BYTES = 16 << 20

LemmaTable = Mapping[str, str] | DataFrame
WordList = Iterable[str] | DataFrame


@dataclass(frozen=True)
class WordLists:
    """Forms with their lemmas, and stop words, each word once."""

    forms: pa.Array
    lemmas: pa.Array
    stops: pa.Array

    @property
    def nbytes(self) -> int:
        return self.forms.nbytes + self.lemmas.nbytes + self.stops.nbytes

    def resolve(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The lemma of each word, and whether it is kept."""
        at = pc.index_in(words, value_set=self.forms)
        lemmas = pc.coalesce(self.lemmas.take(at), words)
        kept = pc.match_substring_regex(lemmas, tokens.ONLY_LETTERS)
        kept = pc.and_(kept, pc.greater_equal(pc.binary_length(lemmas), tokens.MIN_LENGTH))
        kept = pc.and_(kept, pc.invert(pc.is_in(lemmas, value_set=self.stops)))
        return lemmas, kept.to_numpy(zero_copy_only=False)

    def forms_that_count(self) -> list[str]:
        """Listed forms with a lemma that is kept."""
        lemmas, kept = self.resolve(self.forms)
        return self.forms.filter(pa.array(kept)).to_pylist()


def _lemma_pairs(lemma_of: DataFrame) -> DataFrame:
    """The different ``form, lemma`` of a table, without nulls, staged as they are read several times.

    A table that has two lemmas for one form is rejected.
    """
    pairs = staged(lemma_of.select("form", "lemma").dropna().distinct(), "lemma-pairs")
    twice = pairs.groupBy("form").agg(F.count(F.lit(1)).alias("n")).where("n > 1").first()
    if twice:
        raise ValueError(f"more than one lemma for the form {twice.form!r}")
    return pairs


def _collected(words: DataFrame) -> pa.Table | None:
    """The rows of a list, or None if they may be too many or too long."""
    long = [F.length(column) > LONGEST_FORM for column in words.columns]
    size = words.agg(F.count(F.lit(1)).alias("n"), F.max(F.greatest(*long, F.lit(False))).alias("long"))
    found = size.first()
    return None if found.n > MOST_FORMS or found.long else words.toArrow()


def word_lists(lemma_of: LemmaTable, stop_words: WordList) -> WordLists | None:
    """Both lists on the driver, or None where one is too long for that."""
    if isinstance(lemma_of, DataFrame):
        lemma_of = _lemma_pairs(lemma_of)
    return _lists_of(lemma_of, stop_words)


def _lists_of(lemma_of: LemmaTable, stop_words: WordList) -> WordLists | None:
    """``word_lists`` with a table of lemmas that has been checked."""
    if isinstance(lemma_of, DataFrame):
        table = _collected(lemma_of)
        if table is None:
            return None
        forms, lemmas = (table.column(name).combine_chunks() for name in ("form", "lemma"))
    else:
        forms = pa.array(list(lemma_of), pa.string())
        lemmas = pa.array([lemma_of[form] for form in lemma_of], pa.string())
    if isinstance(stop_words, DataFrame):
        table = _collected(stop_words.select("word").dropna().distinct())
        if table is None:
            return None
        stops = table.column("word").combine_chunks()
    else:
        stops = pa.array(sorted(set(stop_words)), pa.string())
    lists = WordLists(*(words.cast(pa.string()) for words in (forms, lemmas, stops)))
    return lists if max(len(lists.forms), len(lists.stops)) <= MOST_FORMS else None


def _cut(body: Column, lists: WordLists) -> Column:
    """Words that may lead to a kept lemma; all words if a listed form is of another kind."""
    listed = lists.forms_that_count()
    plain = all(map(tokens.is_kept_word, listed))
    return tokens.kept_words(body) if plain else tokens.word_forms(body)


def lemmatise(
    articles: DataFrame,
    lemma_of: LemmaTable = IRREGULAR_LEMMAS,
    stop_words: WordList = (),
    body: str = "text",
) -> DataFrame:
    """Replace the ``body`` column by ``lemmas``, an array in text order.

    ``lemma_of`` maps word forms to lemmas, as a mapping or as a table
    ``form, lemma``; a form with two lemmas is an error. ``stop_words`` is a
    list or a table ``word``. Articles without a kept lemma stay, with an
    empty array, and so do repeated rows.
    """
    if isinstance(lemma_of, DataFrame):
        lemma_of = _lemma_pairs(lemma_of)
    lists = _lists_of(lemma_of, stop_words)
    if lists is None:
        return _joined(articles, lemma_of, stop_words, body)
    shared = articles.sparkSession.sparkContext.broadcast(lists)
    carried = [field for field in articles.schema.fields if field.name != body]
    names = [field.name for field in carried]
    schema = T.StructType([*carried, T.StructField("lemmas", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Every piece looks the list through once, so it is no shorter than the list.
        for batch in in_pieces(batches, max(AT_ONCE, shared.value.nbytes)):
            found = kept_lemmas(batch.column(len(names)), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=[*names, "lemmas"])

    words = _cut(F.col(body), lists).alias("words")
    return articles.select(*names, words).mapInArrow(run, schema)


def kept_lemmas(words: pa.ListArray, lists: WordLists) -> pa.ListArray:
    """The kept lemmas of each row; every different word of the batch is looked up once."""
    coded = words.flatten().dictionary_encode()
    lemmas, kept = lists.resolve(coded.dictionary.cast(pa.string()))
    codes = coded.indices.to_numpy()
    stays = kept[codes] if len(kept) else np.zeros(0, bool)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
    before = np.concatenate([[0], np.cumsum(stays)])
    offsets = before[np.concatenate([[0], ends]).astype(np.int64)].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), lemmas.take(pa.array(codes[stays])))


def lemmatise_by_join(
    articles: DataFrame,
    lemma_of: LemmaTable = IRREGULAR_LEMMAS,
    stop_words: WordList = (),
    body: str = "text",
) -> DataFrame:
    """The same with word lists of any size.

    Articles are written out in blocks as numbers, beside the different words
    of each block. Only these are joined with the lists; a word that makes up
    much of all text is one row per block. Each block then meets its lemmas.
    """
    if isinstance(lemma_of, DataFrame):
        lemma_of = _lemma_pairs(lemma_of)
    return _joined(articles, lemma_of, stop_words, body)


def _in_blocks(articles: DataFrame, carried: list[str], words: Column) -> DataFrame:
    """``block``, the carried columns and ``codes`` of each article, staged.

    A row with ``words`` is no article: it lists the different words of a
    block, and a code is a place in that list.
    """
    fields = [T.StructField(f"c{i}", articles.schema[name].dataType) for i, name in enumerate(carried)]
    texts, numbers = T.ArrayType(T.StringType()), T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("words", texts), *fields,
                           T.StructField("codes", numbers)])
    n = len(carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        for nth, batch in enumerate(in_pieces(batches, BLOCK_BYTES)):
            coded = batch.column(n).flatten().dictionary_encode()
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(n)), 0).to_numpy(zero_copy_only=False))
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            codes = pa.ListArray.from_arrays(offsets, coded.indices)
            listed = coded.dictionary.cast(pa.string())
            words = pa.ListArray.from_arrays(pa.array([0, len(listed)], pa.int32()), listed)
            for rows, own_words, own, own_codes in (
                (1, words, [pa.nulls(1, c.type) for c in batch.columns[:n]], pa.nulls(1, codes.type)),
                (batch.num_rows, pa.nulls(batch.num_rows, words.type), batch.columns[:n], codes),
            ):
                block = pa.array(np.full(rows, first + nth))
                yield pa.RecordBatch.from_arrays([block, own_words, *own, own_codes], names=schema.names)

    own = [F.col(f"`{name}`").alias(f"c{i}") for i, name in enumerate(carried)]
    return staged(articles.select(*own, words.alias("words")).mapInArrow(run, schema), "word-blocks")


def _joined(
    articles: DataFrame, lemma_of: LemmaTable, stop_words: WordList, body: str
) -> DataFrame:
    """``lemmatise_by_join`` with a table of lemmas that has been checked."""
    spark = articles.sparkSession
    if isinstance(lemma_of, DataFrame):
        pairs = lemma_of.select("form", "lemma")
    else:
        pairs = spark.createDataFrame(list(lemma_of.items()), "form string, lemma string").dropna()
    if isinstance(stop_words, DataFrame):
        stops = stop_words.select("word").dropna().distinct()
    else:
        stops = spark.createDataFrame([(word,) for word in set(stop_words)], "word string")
    # Where no form of another kind leads to a kept lemma, the kept words are enough.
    other = tokens.is_kept(F.col("lemma")) & ~tokens.is_kept(F.col("form"))
    plain = pairs.where(other).first() is None
    words = tokens.kept_words(F.col(body)) if plain else tokens.word_forms(F.col(body))

    carried = [c for c in articles.columns if c != body]
    blocks = _in_blocks(articles, carried, words)
    is_list = F.col("words").isNotNull()
    forms = blocks.where(is_list).select("block", F.posexplode("words").alias("code", "form"))
    found = forms.join(pairs, "form", "left").select(
        "block", "code", F.coalesce("lemma", "form").alias("word"), (F.col("code") % SALTS).alias("salt")
    ).where(tokens.is_kept(F.col("word")))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    kept = found.join(stops.select("word", salts), ["word", "salt"], "left_anti")
    kept = kept.select(F.col("block").alias("of_block"), "code", "word")

    fields = [T.StructField(f"c{i}", articles.schema[name].dataType) for i, name in enumerate(carried)]
    schema = T.StructType([*fields, T.StructField("lemmas", T.ArrayType(T.StringType()))])

    def named(rows: pa.Table, known: pa.Table) -> pa.Table:
        lists = rows.column("codes").combine_chunks()
        codes = lists.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        listed = known.column("code").to_numpy()
        at = np.full(max(codes.max(initial=-1), listed.max(initial=-1)) + 1, -1)
        at[listed] = np.arange(len(listed))
        places = at[codes]
        stays = places >= 0
        before = np.concatenate([[0], np.cumsum(stays)])
        offsets = before[np.concatenate([[0], ends]).astype(np.int64)].astype(np.int32)
        lemmas = known.column("word").combine_chunks().take(pa.array(places[stays]))
        own = [rows.column(name) for name in schema.names[:-1]]
        made = pa.ListArray.from_arrays(pa.array(offsets), lemmas.cast(pa.string()))
        return pa.table([*own, made], names=schema.names)

    rows = blocks.where(~is_list).drop("words")
    met = rows.groupBy("block").cogroup(kept.groupBy("of_block")).applyInArrow(named, schema)
    return met.select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(carried)], "lemmas")


def lemmatise_with(
    articles: DataFrame,
    make_lemmatiser: Callable[[], Callable[[str], list[str]]],
    stop_words: Iterable[str] = (),
    body: str = "text",
) -> DataFrame:
    """Lemmas from a Python lemmatiser, which is set up once per partition."""
    carried = [f for f in articles.schema.fields if f.name != body]
    names = [f.name for f in carried]
    schema = T.StructType([*carried, T.StructField("lemmas", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lemmatiser = make_lemmatiser()
        # The words of a text take several times its bytes.
        for batch in in_pieces(batches, AT_ONCE // 4):
            found = [lemmatiser(text) for text in batch.column(len(names)).to_pylist()]
            found = pa.array(found, pa.list_(pa.string()), from_pandas=True)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=schema.names)

    plain = articles.withColumn(body, tokens.plain_text(F.col(body)))
    found = plain.select(*names, body).mapInArrow(run, schema)
    return found.withColumn("lemmas", tokens.keep(F.col("lemmas"), sorted(set(stop_words))))


def distinct_lemmas(lemmas: DataFrame) -> DataFrame:
    """``docid, lemma``, each lemma of an article once."""
    rows = lemmas.select("docid", F.explode_outer(F.array_distinct("lemmas")).alias("lemma"))
    return rows.where(F.col("lemma").isNotNull())
