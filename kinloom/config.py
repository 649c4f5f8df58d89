"""Blocking schemes and engine settings."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass


@dataclass(frozen=True, order=True)
class Key:
    """An attribute (by position, the id not counted) and the encoder of its blocking keys."""

    field: int
    encoder: str


@dataclass(frozen=True)
class Term:
    """A conjunction of keys. Keys of oversized blocks are banned."""

    keys: tuple[Key, ...]
    score: float = 0.0
    banned: frozenset[str] = frozenset()

    def __or__(self, other: Term) -> Term:
        return Term(tuple(dict.fromkeys((*self.keys, *other.keys))))

    def same(self, other: Term) -> bool:
        return set(self.keys) == set(other.keys)


@dataclass(frozen=True)
class Scheme:
    """A disjunction of terms."""

    terms: tuple[Term, ...]

    @staticmethod
    def of(*terms: Iterable[tuple[int, str]]) -> Scheme:
        return Scheme(tuple(Term(tuple(Key(f, e) for f, e in t)) for t in terms))

    @staticmethod
    def from_rows(rows: Iterable[tuple[int, int, str]]) -> Scheme:
        """Rows (term number, field, encoder); a new term begins where the number changes."""
        terms: list[list[Key]] = []
        last = None
        for number, position, encoder in rows:
            if not terms or number != last:
                terms.append([])
            last = number
            terms[-1].append(Key(position, encoder))
        return Scheme(tuple(Term(tuple(t)) for t in terms))

    def rows(self) -> list[tuple[int, int, str, float]]:
        return [(i, k.field, k.encoder, t.score) for i, t in enumerate(self.terms) for k in t.keys]

    def fields(self) -> set[int]:
        return {k.field for t in self.terms for k in t.keys}

    def to_json(self) -> str:
        return json.dumps(
            [{"keys": [asdict(k) for k in t.keys], "score": t.score, "banned": sorted(t.banned)} for t in self.terms]
        )

    @staticmethod
    def from_json(text: str) -> Scheme:
        return Scheme(
            tuple(Term(tuple(Key(**k) for k in t["keys"]), t["score"], frozenset(t["banned"])) for t in json.loads(text))
        )


@dataclass(frozen=True)
class Settings:
    """Defaults of the engine; ``max_disjunction`` is the true maximum of terms."""

    lower: float = 0.1
    upper: float = 0.6
    window: int = 2
    positive_part: float = 0.1
    negative_part: float = 0.25
    max_positive: int | None = None
    max_negative: int | None = None
    max_conjunction: int = 2
    max_disjunction: int = 2
    max_block: int = 100
    min_good: float = 0.9
    encoders: tuple[str, ...] = ("term_id", "tokens")
    by_average_precision: bool = True
    vector: str = "block"  # or parfull, full
    indexer: str = "dnf"  # or lsh, kmeans
    lsh_threshold: float = 0.3
    lsh_permutations: int = 60
    clusters: int = -1
    grid: tuple[float, ...] = (0.1, 1.0, 10.0, 100.0, 1000.0)
    use_classifier: bool = True
    families: tuple[str, ...] = ("linear", "rbf", "tree")
    scoring: str = "f1"
    train_positive: int = 2000
    train_negative: int = 3000
    seed: int = 17
