"""Fit / transform stages for ``pyspark.ml.Pipeline``, which can be saved and loaded.

Settings are ``Param``s and are stored as every stage's are. What a stage has
learned or was given as a table (a label bank, a vocabulary) is a parquet table
beside them, read again when the stage is loaded:

    Pipeline(stages=[...]).fit(raw).write().overwrite().save(path)
    PipelineModel.load(path).transform(more)
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclabel.functions.text import clean_words
from doclabel.operators.labels import clean_codes, drop_unusable
from doclabel.operators.phrases import PHRASE_SHARE
from doclabel.operators.tokens import select_in_vocab
from doclabel.plans.corpus import Tagger, build_phrase_vocab, tag_by
from doclabel.staging import stage


def _text(name: str, doc: str) -> Param:
    return Param(Params._dummy(), name, doc, TypeConverters.toString)


class _TableWriter(MLWriter):
    """Params as for every stage, and each of the stage's tables as parquet."""

    def __init__(self, instance: _WithTables):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:  # noqa: N802 - the name that MLWriter calls
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sc)
        for name in self.instance.TABLES:
            getattr(self.instance, name).write.parquet(f"{path}/tables/{name}")


class _TableReader(MLReader):
    def __init__(self, kind: type[_WithTables]):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> _WithTables:
        metadata = DefaultParamsReader.loadMetadata(path, self.sc)
        tables = {name: self.sparkSession.read.parquet(f"{path}/tables/{name}") for name in self.kind.TABLES}
        instance = self.kind(**tables)
        instance._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(instance, metadata)
        return instance


class _WithTables(MLWritable, MLReadable):
    """A stage whose constructor takes its tables by name."""

    TABLES: tuple[str, ...] = ()

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)


class ColumnSelector(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Keep the named columns."""

    columns = Param(Params._dummy(), "columns", "columns to keep", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, columns=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.select(*self.getOrDefault(self.columns))


class AbstractCleaner(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Replace a text column by its clean words."""

    textCol = _text("textCol", "text column")

    @keyword_only
    def __init__(self, *, textCol="Abstract"):
        super().__init__()
        self._setDefault(textCol="Abstract")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        column = self.getOrDefault(self.textCol)
        return dataset.withColumn(column, clean_words(F.col(column)))


class CodeCleaner(Transformer, _WithTables):
    """Split, cut, de-duplicate and validate the codes against a bank."""

    TABLES = ("bank",)
    depth = Param(Params._dummy(), "depth", "length of the code prefixes", TypeConverters.toInt)
    codesCol = _text("codesCol", "column of codes")

    def __init__(self, bank: DataFrame, depth: int = 5, codes: str = "MSCs"):
        super().__init__()
        self.bank = bank
        self._set(depth=depth, codesCol=codes)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return clean_codes(dataset, self.bank, self.getOrDefault(self.depth), self.getOrDefault(self.codesCol))


class UsableFilter(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Drop papers without a code or with too few words."""

    codesCol, wordsCol = _text("codesCol", "column of codes"), _text("wordsCol", "column of word lists")
    minWords = Param(Params._dummy(), "minWords", "fewest words", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, codesCol="MSCs", wordsCol="Abstract", minWords=10):
        super().__init__()
        self._setDefault(codesCol="MSCs", wordsCol="Abstract", minWords=10)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return drop_unusable(dataset, *(self.getOrDefault(p) for p in (self.codesCol, self.wordsCol, self.minWords)))


class VocabSelector(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Learn the vocabulary with phrases; the model rewrites word lists with it.

    A word's part of speech comes from ``tagRule``, an SQL expression over ``word``
    and ``pos``, which is stored with the stage, or from a ``tagger`` function; a
    stage with a function can be fitted, and its model stored, but not the stage.
    """

    tagRule = _text("tagRule", "SQL expression of a word's part of speech")
    share = Param(Params._dummy(), "share", "phrases by vocabulary size", TypeConverters.toFloat)
    idCol, wordsCol = _text("idCol", "column of paper ids"), _text("wordsCol", "column of word lists")

    def __init__(self, tagger: Tagger | None = None, share: float = PHRASE_SHARE, id_col: str = "paper_id", words: str = "Abstract", tag_rule: str | None = None):
        super().__init__()
        self.tagger = tagger
        self._set(share=share, idCol=id_col, wordsCol=words)
        if tag_rule is not None:
            self._set(tagRule=tag_rule)

    def write(self) -> MLWriter:
        if self.tagger is not None:
            raise ValueError("a tagger function cannot be stored: give the stage a tag_rule, or store its model")
        return super().write()

    def _fit(self, dataset: DataFrame) -> VocabModel:
        id_col, words = self.getOrDefault(self.idCol), self.getOrDefault(self.wordsCol)
        cleaned = stage(dataset.select(id_col, words), "cleaned")  # several passes read it
        tagger = tag_by(self.getOrDefault(self.tagRule)) if self.tagger is None else self.tagger
        vocab = build_phrase_vocab(cleaned, tagger, self.getOrDefault(self.share), id_col, words)
        return VocabModel(vocab, words).setParent(self)


class VocabModel(Model, _WithTables):
    """Rewrites word lists to the words and phrases of its vocabulary."""

    TABLES = ("vocab",)
    wordsCol = _text("wordsCol", "column of word lists")

    def __init__(self, vocab: DataFrame, words: str = "Abstract"):
        super().__init__()
        self.vocab = vocab
        self._set(wordsCol=words)

    def setParent(self, parent: VocabSelector) -> VocabModel:  # noqa: N802 - as in pyspark.ml
        self.parent = parent.uid
        return self

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return select_in_vocab(dataset, self.vocab, self.getOrDefault(self.wordsCol))
