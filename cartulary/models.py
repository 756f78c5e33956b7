"""What a language model is asked for, and how one is chosen.

Every call turns into one prompt and one response, so a model is any function from a prompt to a response that can
be pickled; pipelines apply it in the workers. Remote transports are not part of this repository: wrap one in such a function.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import Any, Protocol

from cartulary.functions.json_repair import repaired
from cartulary.operators.extract import PROMPTS

Respond = Callable[[str], str]


class LanguageModel(Protocol):
    """The calls that extraction, merging and questions make."""

    def preflight(self) -> str | None: ...
    def extract_concepts(self, title: str, pages: str, labels: Sequence[str], outline: Sequence[str], text: str) -> dict: ...
    def propose_edges(self, labels: Sequence[str], title: str) -> list[dict]: ...
    def summarize_concept(self, label: str, text: str) -> str: ...
    def answer_question(self, question: str, context: str) -> dict: ...
    def propose_merges(self, a: Sequence[str], b: Sequence[str]) -> list[dict]: ...
    def generate(self, prompt: str) -> str: ...


def filled(template: str, **parts: str) -> str:
    """A template with {name} for parts, each put in once, so that what a part holds is never a place for another."""
    out, rest = [], template
    while rest:
        found = min(((rest.find("{" + k + "}"), k) for k in parts if "{" + k + "}" in rest), default=None)
        if found is None:
            break
        at, k = found
        out += [rest[:at], parts[k]]
        rest = rest[at + len(k) + 2 :]
    return "".join([*out, rest])


class PromptModel:
    """All calls by one function from a prompt to a response."""

    def __init__(self, respond: Respond, ready: Callable[[], str | None] = lambda: None):
        self.respond, self.ready = respond, ready

    def preflight(self) -> str | None:
        """What stands in the way of asking; null if nothing does."""
        return self.ready()

    def generate(self, prompt: str) -> str:
        return self.respond(prompt)

    def _read(self, name: str, **parts: str) -> Any:
        text = repaired(self.generate(filled(PROMPTS[name], **parts)))
        try:
            return json.loads(text)
        except ValueError as e:
            raise ValueError(f"the response to {name} can't be read") from e

    def extract_concepts(self, title: str, pages: str, labels: Sequence[str], outline: Sequence[str], text: str) -> dict:
        return self._read("extract", title=title, pages=pages, labels="; ".join(labels), outline="; ".join(outline), text=text)

    def propose_edges(self, labels: Sequence[str], title: str) -> list[dict]:
        found = self._read("relations", labels="; ".join(labels), title=title)
        return found.get("edges", []) if isinstance(found, dict) else found

    def summarize_concept(self, label: str, text: str) -> str:
        return self.generate(filled(PROMPTS["summary"], label=label, text=text)).strip()

    def answer_question(self, question: str, context: str) -> dict:
        return self._read("answer", question=question, context=context)

    def propose_merges(self, a: Sequence[str], b: Sequence[str]) -> list[dict]:
        return self._read("merges", a="; ".join(a), b="; ".join(b))


def create_model(kind: str, known: dict[str, tuple[Callable[[str | None], Respond], bool]], key: str | None = None) -> PromptModel:
    """The model of a kind. known: kind -> (what makes its function from a key, whether it needs a key)."""
    if kind not in known:
        raise ValueError(f"no model of kind {kind}")
    make, needs_key = known[kind]
    if needs_key and not key:
        raise ValueError(f"a model of kind {kind} needs a key")
    return PromptModel(make(key))
