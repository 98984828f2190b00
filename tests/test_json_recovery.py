"""Recovery of JSON from generations: one pass of brackets against a scan from each of them."""

import json
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from grainmill.operators import labels
from grainmill.operators.scoring import DOMAINS

TOPIC = {"domain": "water", "issue": "leak", "object": "", "requested_action": "", "attributes": {}}
ONE, BAD = json.dumps(TOPIC), json.dumps(TOPIC | {"domain": "sea"})


def slow(text):
    def valid(t):
        texts = lambda *ks: all(isinstance(t.get(k), str) for k in ks)
        return isinstance(t, dict) and t.get("domain") in DOMAINS and texts("issue", "object", "requested_action") and isinstance(t.get("attributes"), dict) and all(isinstance(v, str) for v in t["attributes"].values())

    for m in re.finditer(r"[{\[]", text):
        values, at = [], m.start()
        while hit := labels.balanced_json(text, at):
            values.append(hit[0])
            tail = re.compile(r"\s*,").match(text, hit[1])
            if not tail:
                break
            at = tail.end()
        if not values:
            continue
        try:
            got = json.loads(values[0] if len(values) == 1 else f"[{','.join(values)}]")
        except ValueError:
            continue
        topics = got if isinstance(got, list) else got.get("topics") if isinstance(got.get("topics"), list) else [got]
        if all(map(valid, topics)):
            return topics
    return None


PARTS = st.sampled_from(["{", "}", "[", "]", '"', "\\", ",", " ", "x", ":", ONE, BAD, "{}", "[]", '{"topics":[', '"a":', "\n"])


@settings(max_examples=1500, deadline=None)
@given(st.lists(PARTS, max_size=24).map("".join))
def test_brackets(text):
    want = {m.start(): hit[1] for m in re.finditer(r"[{\[]", text) if (hit := labels.balanced_json(text, m.start())) and hit[0][0] == m.group()}
    assert labels.bracket_ends(text) == want


@settings(max_examples=1500, deadline=None)
@given(st.lists(PARTS, max_size=16).map("".join))
def test_topics(text):
    assert labels.find_topics(text) == slow(text)


def test_rows_and_wrappers():
    assert len(labels.find_topics(f"noise {{x}} {ONE}, {ONE} tail")) == 2
    assert labels.find_topics(f"{ONE}, {BAD}, {ONE}") == slow(f"{ONE}, {BAD}, {ONE}")
    assert labels.find_topics(f'say "[" then {{"topics": [{ONE}]}}') == [TOPIC]
    assert labels.find_topics(f"{ONE}, {{") == [TOPIC] and labels.find_topics("[]") == [] and labels.find_topics(None) is None


def test_linear():
    for text in ("[" * 1_000_000, "{" * 500_000 + "}" * 500_000, '["' * 300_000, "[" * 300_000 + "]" * 300_000, f"{ONE}, " * 3000 + BAD, '\\"[' * 200_000):
        began = time.time()
        labels.find_topics(text)
        assert time.time() - began < 8, text[:20]  # a second or so where nothing else runs
