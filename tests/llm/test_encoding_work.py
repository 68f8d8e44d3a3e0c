"""The SentencePiece scan looks at what words have in common once."""

import itertools

import numpy as np
from flowlens.llm import sentencepiece_codec
from tests.llm.test_models import MODEL, _library


def test_words_share_the_scan_of_what_they_begin_with(monkeypatch):
    own, model, asked = sentencepiece_codec.Codec(MODEL), _library(), []
    follows = own.follows
    monkeypatch.setattr(own, "follows", lambda x, y: asked.append((x, y)) or follows(x, y))
    words = ["schtionenheiterou" + "".join(x) for x in itertools.product("aeinrst", repeat=3)]
    texts = [" ".join(words), "  ".join(words[::-1]), " " + words[0] + ",漢" + words[1] + ".\n" + words[2]]
    got = own.encode_all(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [model.encode(x) for x in texts]
    assert len(asked) < 3 * len(words)  # a scan of each word alone asks at every place of it
