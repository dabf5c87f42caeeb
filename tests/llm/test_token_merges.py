"""Pre-tokens that are not yet known go through the model, not through the whole library again."""

import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import token_counts


def test_unknown_pieces_are_merged_by_the_model_alone(monkeypatch):
    path = public_tokenizers.path(token_counts.VOCABULARY)
    library, counter = Tokenizer.from_file(path), token_counts.WordCounter(path, frozenset())
    texts = ["qzxvth ontionlyin 2048 it's 'LL don't", "ß ŝtraße ἀρχή ά 中文字符 한국어 текст", "é " + "aqz" * 3000, "\x00\x7f!?-- 👍 naïve", "", "A\tB\r\nC", "it's" * 40]
    expected = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    whole = [t for t in texts if not counter.by_pieces(t)]
    asked, alone = [], counter.alone
    monkeypatch.setattr(counter, "alone", lambda pieces: asked.extend(pieces) or alone(pieces))
    assert [counter.count(t) for t in texts] == expected and asked == whole and len(whole) < 4
