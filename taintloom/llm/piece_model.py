"""The facts of a SentencePiece BPE model file that the two operators on it need."""

from __future__ import annotations

import functools
import re

SPACE = "▁"


class PieceModel:
    """Pieces, ranks and byte ids of a BPE model with byte fallback, an identity normaliser and a dummy prefix."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not model.trainer_spec.byte_fallback:
            raise ValueError("the model must be BPE with byte fallback, a dummy prefix and no normalisation")
        self.pieces = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (1, 4, 5)}
        scores = {i: model.pieces[i].score for i in self.ids.values()}
        # A lower rank is merged first; single characters have no rank that counts.
        self.rank = {i: r for r, i in enumerate(sorted(scores, key=lambda i: (-scores[i], i)))}
        self.rank_of = {p: self.rank[i] for p, i in self.ids.items() if len(p) > 1}
        self.byte_ids = [next(i for i, p in enumerate(self.pieces) if p == f"<0x{b:02X}>" and model.pieces[i].type == 6) for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        if any(SPACE in p[1:] and p.strip(SPACE) for p in self.ids):
            raise ValueError("a piece has a space sign after a letter; words can't be encoded apart")
        # No piece goes on past a newline or into a space sign, so a text falls apart there without changing any merge.
        apart = "\n" if not any("\n" in p for p in self.ids) else ""
        self.word_pattern = re.compile(f"{apart}|{SPACE}+[^{SPACE}{apart}]*|[^{SPACE}{apart}]+" if apart else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    def words(self, text: str) -> list[str]:
        """The text with its dummy prefix and space signs, in parts that no merge crosses; none for an empty text."""
        return self.word_pattern.findall(SPACE + text.replace(" ", SPACE)) if text else []


@functools.lru_cache(maxsize=4)
def load(path: str) -> PieceModel:
    return PieceModel(path)
