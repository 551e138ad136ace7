"""The query language: ``{directive}`` and words; the parsed form, its builder and its canonical text."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, replace

from titleforge.errors import ConfigError, NumberError, UnknownDirective
from titleforge.functions.scoring import Scorer
from titleforge.functions.similarity import Similarity
from titleforge.schema import KIND_BY_NAME, parse_kind

MAX_SIZE_DEFAULT, CANDIDATES, STOP_RATIO = 30, 1000, 0.01
_TOKEN = re.compile(r"[{](?P<directive>[^{}]+)[}]|(?P<term>(?:(?![{}\s]).)+)", re.S)  # what neither matches is skipped


@dataclass(frozen=True)
class Range:
    """Inclusive at both ends; None is open."""

    low: int | None = None
    high: int | None = None

    @property
    def open(self) -> bool:
        return self.low is None and self.high is None

    def contains(self, value: int | None) -> bool:
        if value is None:
            return self.open
        return (self.low is None or value >= self.low) and (self.high is None or value <= self.high)

    @classmethod
    def parse(cls, text: str) -> "Range":
        """``a``, ``a-b``, ``a-``, ``-b`` or ``-``."""

        def number(s: str) -> int:
            if not re.fullmatch(r"\+?[0-9]+", s) or int(s) >= 1 << 32:
                raise NumberError(f"invalid number {s!r} in range {text!r}")
            return int(s)

        a, dash, b = text.partition("-")
        a, b = a.strip(), b.strip()
        if not dash:
            return cls(number(a), number(a))
        return cls(number(a) if a else None, number(b) if b else None)

    def __str__(self) -> str:
        if self.low is not None and self.low == self.high:
            return str(self.low)
        return f"{'' if self.low is None else self.low}-{'' if self.high is None else self.high}"


@dataclass(frozen=True)
class NameQuery:
    """A search for names alone."""

    name: str
    size: int = MAX_SIZE_DEFAULT
    scorer: Scorer = Scorer.OKAPI_BM25
    stop_word_ratio: float = STOP_RATIO


@dataclass(frozen=True)
class Query:
    """None and '' are different names: without a name all records are gone through, and '' matches none."""

    name: str | None = None
    scorer: Scorer | None = Scorer.OKAPI_BM25
    similarity: Similarity = Similarity.NONE
    size: int = MAX_SIZE_DEFAULT
    kinds: tuple[str, ...] = ()
    year: Range = Range()
    votes: Range = Range()
    season: Range = Range()
    episode: Range = Range()
    tvshow_id: str | None = None

    # Builder: each method returns a changed query.
    def named(self, name: str | None) -> "Query":
        return replace(self, name=name)

    def name_scorer(self, scorer: Scorer | None) -> "Query":
        return replace(self, scorer=scorer)

    def similar(self, similarity: Similarity) -> "Query":
        return replace(self, similarity=similarity)

    def sized(self, size: int) -> "Query":
        return replace(self, size=size)

    def kind(self, kind: str) -> "Query":
        return self if kind in self.kinds else replace(self, kinds=(*self.kinds, kind))

    def at_least(self, **low: int) -> "Query":
        return replace(self, **{k: Range(v, getattr(self, k).high) for k, v in low.items()})

    def at_most(self, **high: int) -> "Query":
        return replace(self, **{k: Range(getattr(self, k).low, v) for k, v in high.items()})

    def of_show(self, tvshow_id: str) -> "Query":
        return replace(self, tvshow_id=tvshow_id)

    # What a plan needs.
    @property
    def has_filters(self) -> bool:
        return self.needs_title_only or self.needs_rating or self.needs_episode

    @property
    def needs_title_only(self) -> bool:
        return bool(self.kinds) or not self.year.open

    @property
    def needs_rating(self) -> bool:
        return not self.votes.open

    @property
    def needs_episode(self) -> bool:
        return not self.season.open or not self.episode.open or self.tvshow_id is not None

    @property
    def is_empty(self) -> bool:
        return self.name is None and not self.has_filters

    @property
    def by_name(self) -> bool:
        return self.name is not None and self.scorer is not None

    def name_query(self) -> NameQuery | None:
        """The search for candidates: more than wanted, as filters come after it."""
        return NameQuery(self.name, max(CANDIDATES, self.size), self.scorer) if self.by_name else None

    @classmethod
    def parse(cls, text: str) -> "Query":
        q, words = cls(), []
        for m in _TOKEN.finditer(text):
            if m["term"] is not None:
                words.append(m["term"])
            elif m["directive"] is not None:
                q = q._directive(m["directive"])
        return replace(q, name=" ".join(words)) if words else q

    def _directive(self, text: str) -> "Query":
        name, colon, value = text.partition(":")
        if not colon:
            if text.lower() in KIND_BY_NAME:
                return self.kind(parse_kind(text))
            raise UnknownDirective(text)
        name, value = name.strip(), value.strip()
        if name == "size":
            if not re.fullmatch(r"\+?[0-9]+", value):
                raise NumberError(f"invalid size {value!r}")
            return replace(self, size=int(value))
        if name in ("year", "votes", "season", "episode"):
            return replace(self, **{name: Range.parse(value)})
        if name in ("tvseries", "tvshow", "show"):
            return replace(self, tvshow_id=value)
        if name in ("sim", "similarity"):
            return replace(self, similarity=Similarity.parse(value))
        if name == "scorer":
            return replace(self, scorer=None if value == "none" else Scorer.parse(value))
        raise UnknownDirective(name)

    def __str__(self) -> str:
        """The canonical text, which parses to the same query; also the key under which equal queries are one."""
        parts = [f"{{scorer:{self.scorer or 'none'}}}", f"{{sim:{self.similarity}}}", f"{{size:{self.size}}}", *(f"{{{k}}}" for k in sorted(self.kinds))]
        parts += [f"{{{k}:{getattr(self, k)}}}" for k in ("year", "votes", "season", "episode") if not getattr(self, k).open]
        parts += [f"{{show:{self.tvshow_id}}}"] if self.tvshow_id is not None else []
        return " ".join(parts + ([self.name] if self.name else []))

    def to_json(self) -> str:
        return json.dumps(str(self), ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> "Query":
        value = json.loads(text)
        if not isinstance(value, str):
            raise ConfigError(f"a query is a JSON string, not {text!r}")
        return cls.parse(value)
