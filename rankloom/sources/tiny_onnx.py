"""A model and a tokenizer made on the spot, for trials without weights: the model's logit is the number of tokens of a pair."""

from __future__ import annotations

from tokenizers import Tokenizer, models, pre_tokenizers

# Field numbers and type codes of the ONNX protocol buffers.
FLOAT, INT64 = 1, 7


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value: int | str | bytes) -> bytes:
    """A field of a protocol buffer: a number, or bytes with their length."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    data = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _tensor(name: str, kind: int, dims: tuple[str | int, ...]) -> bytes:
    shape = b"".join(_field(1, _field(2, d) if isinstance(d, str) else _field(1, d)) for d in dims)
    return _field(1, name) + _field(2, _field(1, _field(1, kind) + _field(2, shape)))


def _node(kind: str, source: str, target: str, numbers: dict[str, int], lists: dict[str, int]) -> bytes:
    out = _field(1, source) + _field(2, target) + _field(4, kind)
    for name, value in numbers.items():
        out += _field(5, _field(1, name) + _field(3, value) + _field(20, 2))
    for name, value in lists.items():
        out += _field(5, _field(1, name) + _field(8, value) + _field(20, 7))
    return out


def counting_model() -> bytes:
    nodes = [_node("Cast", "attention_mask", "f", {"to": FLOAT}, {}), _node("ReduceSum", "f", "logits", {"keepdims": 1}, {"axes": 1})]
    graph = b"".join(_field(1, n) for n in nodes) + _field(2, "g")
    graph += b"".join(_field(11, _tensor(n, INT64, ("b", "s"))) for n in ("input_ids", "attention_mask")) + _field(12, _tensor("logits", FLOAT, ("b", 1)))
    return _field(1, 7) + _field(7, graph) + _field(8, _field(2, 11))


def word_tokenizer() -> bytes:
    """Each run of characters between blanks is one unknown token."""
    made = Tokenizer(models.WordLevel({"?": 0}, unk_token="?"))
    made.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
    return made.to_str().encode()
