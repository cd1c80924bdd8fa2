import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricemesh.llm import secret_spans as S
from tests.llm import cases

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def brute(text):
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[0], S.KINDS.index(s[2])))


def test_rules_equal_brute_force():
    rng = random.Random(2)
    pieces = ["password", "Secret", "TOKEN", "api_key", "apikey", "tokeN", ":", "=", " ", '"', "'", "abc", "abcdef12", "AKIA", "ABCDEFGH12345678", "0123456789ab", "\n", "é", "ſecret"]
    for _ in range(3000):
        text = "".join(rng.choices(pieces, k=rng.randrange(1, 14)))
        assert S.rule_spans(text) == brute(text)


def secret(rng):
    return "".join(rng.choices("0123456789abcdef", k=40))


@pytest.fixture(scope="module")
def field():
    rng = random.Random(4)
    texts = [f"{cases.prose(k, 20)} token = \"{secret(rng)}\" {cases.prose(k + 1, 9)} version-{k}.10.2b" for k in range(60)]
    return S.fit([x for t in texts for x in S._silver(t)])


def test_field_finds_what_rules_miss(field):
    rng = random.Random(5)
    decoder = S.Decoder(field)
    for text in (f"my login key is '{secret(rng).upper()}' ok", f"{cases.prose(3, 8)} credential: {secret(rng).upper()}"):
        base, spans = S.all_spans(text, decoder)
        assert base == [] and [k for *_, k in spans] == ["crf"]
        a, b, _ = spans[0]
        assert re.fullmatch("[0-9A-F]{40}", text[a:b])
    assert S.all_spans("see release-2.0.1-beta3 and ISO27001:2013 for more", decoder)[1] == []


def test_secrets_of_any_letters(field):
    """Letters only, digits only, short and punctuated values in a secret's place are found, plain text is left alone."""
    rng = random.Random(8)
    decoder = S.Decoder(field)
    values = ["correcthorsebatterystaple", "48219377", "P@ss!w0rd#9", "q7x", "zu\u00e7\u00e7hini"]
    for k in range(40):
        name, value = rng.choice(["pwd", "auth_key", "passphrase", "login"]), values[k % len(values)]
        text = f'{cases.prose(400 + k, 30)} {name} = "{value}" {cases.prose(500 + k, 12)}'
        base, spans = S.all_spans(text, decoder)
        assert base == [] and [text[a:b] for a, b, _ in spans] == [value]
        assert S.all_spans(cases.prose(600 + k, 200), decoder)[1] == []


def whole_path(decoder, scores):
    """Viterbi over all tokens, with no stretch left out."""
    return decoder.path(scores, True, True)


def random_decoder(field, rng):
    decoder = S.Decoder(field)
    decoder.steps = np.array([[rng.gauss(0, 1) for _ in range(3)] for _ in range(3)])
    decoder.steps -= decoder.steps[0, 0]
    decoder.steps[0, 2] = -np.inf
    decoder.bound = decoder.steps[:, 1].max(), decoder.steps[1:, 2].max(), max(0.0, *decoder.steps[1:, 0])
    return decoder


def test_viterbi_is_the_best_path(field):
    rng = random.Random(6)
    for _ in range(40):
        decoder = random_decoder(field, rng)
        scores = np.array([[rng.gauss(-1, 2), rng.gauss(-1, 2)] for _ in range(6)])

        def value(tags):
            if tags[0] == 2:
                return -np.inf
            gains = [0.0 if t == 0 else row[t - 1] for t, row in zip(tags, scores)]
            return sum(gains) + sum(decoder.steps[a][b] for a, b in zip(tags, tags[1:]))

        every = [[k // 3**i % 3 for i in range(6)] for k in range(3**6)]
        found = decoder.tags(scores)
        assert value([found.get(i, 0) for i in range(6)]) == pytest.approx(max(map(value, every)))


def test_stretches_lose_nothing(field):
    rng = random.Random(9)
    for k in range(60):
        decoder = random_decoder(field, rng)
        scores = np.array([[rng.gauss(-2, 2), rng.gauss(-2, 2)] for _ in range(200)])
        found = decoder.tags(scores)
        assert [found.get(i, 0) for i in range(200)] == whole_path(decoder, scores)


def test_scores_are_sums_of_features(field):
    decoder = S.Decoder(field)
    text = ' \n' + cases.prose(2, 30) + ' token: "ab\u00e9-12" x=3; "q" \u03b1\u03b2 ' + cases.prose(3, 5)
    tokens, start = S.tokens_of(text)
    assert text[:start].strip() == "" and text[start:] == "".join(tokens)
    whole = S._text_features(text)
    weights = field.weights - field.weights[:, :1]
    for i, row in enumerate(decoder.scores(tokens, whole)):
        names = [*S._shape(tokens[i].rstrip()), *S.around(tokens, i), *whole]
        assert row == pytest.approx(sum(weights[field.index[f], 1:] for f in names if f in field.index))


def test_whole_table(spark):
    rng = random.Random(7)
    key = secret(rng)
    docs = cases.docs(spark).union(spark.createDataFrame([(90 + k, cases.prose(k, 4000) + f' secret="{key}"', "en", "s", 1) for k in range(3)], cases.SCHEMA))
    docs = docs.withColumns({"spans": F.lit(1), "base": F.lit(2)})
    got = S.scan(docs, S.train(docs)).collect()
    assert len(got) == len(cases.rows()) + 3
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in got:
        assert [tuple(s) for s in r.base] == brute(texts[r.doc_id]) and set(r.base) <= set(r.spans)
    assert sum(bool(r.base) for r in got) == 3
    assert S.train(cases.empty(spark)) is None and S.scan(cases.empty(spark), None).count() == 0
