"""The eight routes of a reading server as one facade: each gives a DataFrame of the rows to send."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lektra.functions import text
from lektra.plans import corpus
from lektra.plans.corpus import Corpus


@dataclass(frozen=True)
class Api:
    corpus: Corpus

    def authors(self, language: str) -> DataFrame:
        return corpus.authors(self.corpus, language)

    def works(self, author_id: str) -> DataFrame:
        return corpus.works(self.corpus, author_id)

    def books(self, work_id: str) -> DataFrame:
        return corpus.books(self.corpus, work_id)

    def text(self, book_id: str, start: int, end: int) -> DataFrame:
        return corpus.text_range(self.corpus, start, end, book_id)

    def translations(self, book_id: str, start: int, end: int, translator: str | None = None) -> DataFrame:
        return corpus.translations(self.corpus, start, end, book_id, translator)

    def translators(self, book_id: str) -> DataFrame:
        return corpus.translators(self.corpus, book_id)

    def _normal(self, word: str) -> DataFrame:
        return self.corpus.spark.createDataFrame([(word,)], "word string").select(
            text.normalize_web(F.col("word")).alias("word_normalized"))

    def dictionary(self, word: str, language: str = "greek") -> DataFrame:
        return corpus.web_dictionary(self.corpus, self._normal(word), language)

    def occurrences(self, word: str, book_id: str | None = None, limit: int = 50) -> DataFrame:
        """Grouped by place, as the server sends them."""
        normal = self._normal(word).first()[0]
        return corpus.grouped_occurrences(corpus.web_occurrences(self.corpus, normal, limit, book_id))
