"""Words that come again stay known to the encoder when the words it knows are too many."""

import public_tokenizers

from eviflow.llm import pieces


def test_frequent_words_are_encoded_once(monkeypatch):
    machine = pieces.Transducer(public_tokenizers.path("piece_bpe_32k.model"))
    monkeypatch.setattr(pieces, "CACHED", 4)
    found, plain = [], machine.shortest
    monkeypatch.setattr(machine, "shortest", lambda word: found.append(word) or plain(word))
    for k in range(40):
        text = f"the harvest w{k} x{k} é{k}☃"
        assert machine.decode(machine.encode(text).tolist()) == text
    assert found.count("▁harvest") == 1 and found.count("▁the") == 1
    assert len(machine.known) + len(machine.older) <= 4 * pieces.CACHED
