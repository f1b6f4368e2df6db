"""Merge tables of byte-pair encodings, shared by encoding and counting.

A token is a str of symbols (chr(byte), or chr(256 + byte) for the last byte of
a word where a vocabulary marks word ends).  Ranks rise with the order in which
merges are tried.
"""

from __future__ import annotations

#: Pair checks that are remembered.
MEMO = 300_000
_NEVER = 1 << 62
_BITS = 21


class Merges:
    """Which tokens may stand side by side in an encoding."""

    def __init__(self, singles: int = 512):
        self.singles = singles
        self.children: dict[int, tuple[int, int]] = {}
        self.pairs: dict[int, int] = {}
        self.memo: dict[int, bool] = {}

    def add(self, token: int, left: int, right: int) -> None:
        """Tokens are added in the order of their merges."""
        self.children[token] = (left, right)
        self.pairs[left << _BITS | right] = token

    def fits(self, left: int, right: int) -> bool:
        """True if the two tokens' symbols together are encoded as just these tokens.

        A merge across the border happens if both its sides exist at its turn:
        a side on the border exists until the merge that makes its parent.  Of
        equal merges the one further left comes first.
        """
        key = left << _BITS | right
        known = self.memo.get(key)
        if known is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            known = self.memo[key] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        pairs, children = self.pairs, self.children
        a, a_until = left, _NEVER
        while True:
            b, b_until = right, _NEVER
            while True:
                merged = pairs.get(a << _BITS | b)
                if merged is not None and merged < a_until and merged <= b_until:
                    return False
                if b not in children:
                    break
                b, b_until = children[b][0], b
            if a not in children:
                return True
            a, a_until = children[a][1], a


def from_ranks(ranks: dict[str, int]) -> tuple[Merges, set[int]]:
    """The merges behind a list of ranked tokens, and the tokens that merges can make.

    A token is made by the one split into two earlier tokens that fit.
    """
    merges = Merges()
    made = {rank for token, rank in ranks.items() if len(token) == 1}
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut], rank), ranks.get(token[cut:], rank)
            if left < rank and right < rank and left in made and right in made and merges._fits(left, right):
                merges.add(rank, left, right)
                made.add(rank)
                break
    return merges, made
