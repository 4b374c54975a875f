"""The masking of one text after another with shared numbering: the state of one scope."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from kryptonym.functions import layers as L
from kryptonym.functions.dictionary import Entry
from kryptonym.functions.rules import LONG_NUMBER, compiled
from kryptonym.functions.text import preprocess


@dataclass(frozen=True)
class Config:
    """What is masked: rules by id (none: those on by default), dictionary entries, optional layers.

    The dictionary and the tagger run whatever rules are enabled; the name pass needs the tagger and rule fio.
    """

    enabled: frozenset[str] | None = None
    dictionary: tuple[Entry, ...] = ()
    tagger: L.Tagger | None = None
    morphology: L.Morphology | None = None

    @property
    def ready(self) -> bool:
        return self.tagger is not None and self.morphology is not None


@dataclass
class Masker:
    config: Config = field(default_factory=Config)
    keys: list[dict] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=dict)  # by label, so that equal labels of different types never collide
    replaced: int = 0

    def __post_init__(self):
        self._known: dict[tuple[str, str], str] = {}
        self._rules = compiled(self.config.enabled)

    def placeholder(self, type_id: str, label: str, value: str) -> str:
        self.replaced += 1
        found = self._known.get((type_id, value))
        if found is None:
            self.counts[label] = self.counts.get(label, 0) + 1
            found = self._known[type_id, value] = f"[{label}_{self.counts[label]}]"
            self.keys.append({"ord": len(self.keys) + 1, "placeholder": found, "type_id": type_id, "type": label, "original": value})
        return found

    def mask(self, text: str | None) -> str | None:
        """Dictionary, rules, tagged entities, names, in this order; null and empty texts stay."""
        if not text:
            return text
        text = preprocess(text)
        for entry in self.config.dictionary:
            text = entry.replaced(text, lambda v, e=entry: self.placeholder(e.type_id, e.label, v))
        long_number = _long_number.search(text)
        for rule, forms, hint in self._rules:
            if long_number if rule.hint is LONG_NUMBER else hint.search(text):
                for form in forms:
                    text = form(text, lambda v, r=rule: self._kept_space(v, r))
        if self.config.tagger is not None and L.tagged(text):
            text = self._entities(text)
        return text

    def _kept_space(self, found: str, rule) -> str:
        """The placeholder of a value, with the white space around it."""
        value = found.strip()
        if not value:
            return found
        head, _, tail = found.partition(value)
        return head + self.placeholder(rule.id, rule.label, value) + tail

    def _entities(self, text: str) -> str:
        """From the last to the first, so that spans stay valid; the last entity of a text gets the lowest number."""
        for span, value in L.kept_spans(text, self.config.tagger, self.config.morphology):
            made = self.placeholder(span.type_id, span.label, value)
            text = text[: span.start] + text[span.start : span.stop].replace(value, made, 1) + text[span.stop :]
        morphology = self.config.morphology
        if morphology is None or not any(r.id == "fio" for r, _, _ in self._rules):
            return text
        out, at = [], 0
        for m in L.names(text, morphology):
            out += [text[at : m.start()], self.placeholder("fio", "ФИО", m[0])]
            at = m.end()
        return "".join([*out, text[at:]])


_long_number = re.compile(LONG_NUMBER)
PASSES = 10


def restore(text: str, keys: list[tuple[str, str]]) -> str:
    """Originals (placeholder, original) put back, in their order, until nothing changes, in at most PASSES passes."""
    for _ in range(PASSES):
        before = text
        for placeholder, original in keys:
            text = text.replace(placeholder, original)
        if text == before:
            break
    return text


def ambiguous(text: str) -> list[str]:
    """Strings of a raw text that already look like placeholders: restoring can't tell them from ours."""
    return re.findall(r"\[[A-ZА-ЯЁ][A-ZА-ЯЁ_]*_\d+\]", text or "")
