"""Languages by name, and files to tokens as a DataFrame."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.tokenize import lexical, models, python_source
from simloom.tokenize.base import END, ParseError, Tok


@dataclass(frozen=True)
class Language:
    """A tokeniser with the suffixes of its files and its least match; ``normal`` gives order-free tokens."""

    name: str
    suffixes: tuple[str, ...]
    min_match: int
    tokenize: Callable[[str], list[Tok]]
    normal: Callable[[str], list[Tok]] | None = None
    priority: int = 0


def words(text: str) -> list[Tok]:
    """Lower-cased words with their places; any of LF, CR and CRLF ends a line."""
    out = []
    for n, line in enumerate(re.split(r"\r\n|\r|\n", text), 1):
        out += [Tok(m[0].lower(), n, m.start() + 1, len(m[0])) for m in re.finditer(r"[^\W_]+", line)]
    return out


def _lexical(name: str, suffixes: str, least: int) -> Language:
    return Language(name, tuple(suffixes.split()), least, partial(lexical.tokenize, lex=lexical.LEXICONS[name]))


_LANGUAGES = (
    Language("text", tuple(".txt .asc .tex .md .rtf .csv .wiki .json .yaml .yml .xml".split()), 5, words),
    _lexical("java", ".java", 9),
    Language("cpp", tuple(".cpp .cxx .c++ .c .cc .h .hpp .hh .hxx".split()), 12, partial(lexical.tokenize, lex=lexical.LEXICONS["cpp"]), priority=1),
    _lexical("c", ".cpp .cxx .c++ .c .cc .h .hpp .hh .hxx", 12),
    _lexical("csharp", ".cs", 8),
    Language("python3", (".py",), 12, python_source.tokenize),
    Language("javascript", (".js",), 12, partial(lexical.tokenize, lex=lexical.LEXICONS["javascript"]), priority=1),
    _lexical("typescript", ".ts .js", 12),
    _lexical("golang", ".go", 8),
    _lexical("kotlin", ".kt", 8),
    _lexical("rlang", ".R", 8),
    _lexical("rust", ".rs", 8),
    _lexical("swift", ".swift", 8),
    _lexical("scala", ".scala .sc", 8),
    _lexical("llvmir", ".ll", 70),
    _lexical("scheme", ".scm .ss", 13),
    Language("emf", (".ecore",), 6, partial(models.tokenize, table=models.METAMODEL), partial(models.tokenize, table=models.METAMODEL, order=models.nearest_neighbor), priority=1),
    Language("emf-dynamic", (".ecore",), 10, partial(models.tokenize, table=None)),
    Language("emf-model", (), 10, partial(models.tokenize, table=None), partial(models.tokenize, table=None, order=models.nearest_neighbor)),
    Language("scxml", (".scxml",), 6, partial(models.tokenize, table=models.STATECHART), partial(models.tokenize, table=models.STATECHART, order=models.by_content)),
)


def registered(languages: tuple[Language, ...] = _LANGUAGES) -> dict[str, Language]:
    """By name; of languages with the same name none counts."""
    names = [x.name for x in languages]
    return {x.name: x for x in languages if names.count(x.name) == 1}


LANGUAGES = registered()


def by_suffix(languages: list[Language]) -> dict[str, Language]:
    """The language of each suffix: that of the highest priority; a tie is an error."""
    out: dict[str, Language] = {}
    for x in languages:
        for s in x.suffixes:
            old = out.get(s.lower())
            if old and old.priority == x.priority:
                raise ValueError(f"{s} is a suffix of {old.name} and {x.name}")
            if not old or x.priority > old.priority:
                out[s.lower()] = x
    return out


def chosen(language: str) -> Callable[[str], Language | None]:
    """From a path to its language; ``multi`` goes by suffix, over languages without conflicts."""
    if language != "multi":
        return lambda path: LANGUAGES[language]
    table = by_suffix([x for x in LANGUAGES.values() if x.name not in ("emf-dynamic", "emf-model")])
    return lambda path: next((table[s] for s in sorted(table, key=len, reverse=True) if path.lower().endswith(s)), None)


TOKENS = "array<struct<type:string,line:int,column:int,length:int>>"


def tokenized(files: DataFrame, language: str, normalize: bool = False) -> DataFrame:
    """``files(path, text, ...)`` with ``tokens`` and ``error``; each file ends with one end token.

    A file whose tokeniser fails in any way has an error and no tokens; a null text too. With ``normalize``, languages that
    have an order of their own give it.
    """

    @F.arrow_udf(f"tokens {TOKENS}, error string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        find = chosen(language)
        kind = pa.list_(pa.struct([("type", pa.string()), ("line", pa.int32()), ("column", pa.int32()), ("length", pa.int32())]))
        for paths, texts in batches:
            tokens, errors = [], []
            for path, text in zip(paths.to_pylist(), texts.to_pylist(), strict=True):
                try:
                    lang = find(path or "")
                    if lang is None or text is None:
                        raise ParseError("no language" if text is not None else "no text")
                    f = lang.normal if normalize and lang.normal else lang.tokenize
                    tokens.append([t._asdict() for t in [*f(text), END]])
                    errors.append(None)
                except Exception as e:  # whatever a tokeniser fails with, the file can't be parsed and others can
                    tokens.append(None)
                    errors.append(str(e) or type(e).__name__)
            yield pa.StructArray.from_arrays([pa.array(tokens, kind), pa.array(errors, pa.string())], names=["tokens", "error"])

    found = run(F.col("path").cast("string"), F.col("text").cast("string"))
    return files.withColumn("__t", found).select(*files.columns, "__t.tokens", "__t.error")
