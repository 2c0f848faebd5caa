"""Credentials glued to a name, a path or a query are found."""

import pytest

from scenewright.llm import secret_scan


@pytest.mark.parametrize("form", ["SOME_NAME={}", "see https://host.example/hook/{}", "https://host.example/a?x={}", "auth={} and more"])
def test_glued_credentials_are_learned_spans(form):
    automata = secret_scan.default_automata()
    fresh = secret_scan.labelled(seed=77, each=30)
    for kind in fresh.keys() - {"words"}:
        at = form.index("{")
        found = secret_scan.scan([form.format(v).encode() for v in fresh[kind]], automata)
        hits = sum(any(a < at + len(v) and at < b and b - a <= len(v) + 6 for a, _, b, _ in spans) for v, spans in zip(fresh[kind], found))
        assert hits >= 27, (kind, hits)
