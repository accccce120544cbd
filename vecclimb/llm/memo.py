"""A bounded memo of what costs time for each word."""

from __future__ import annotations

from collections.abc import Callable, Iterable


class Memo:
    """Values by word. Words met in two batches are kept, those met once make room for others; when
    too many are kept, they have to be met again."""

    def __init__(self, most: int):
        self.most = most
        self.kept: dict[str, bytes] = {}
        self.young: dict[str, bytes] = {}

    def values(self, words: Iterable[str], compute: Callable[[list[str]], list[bytes]]) -> dict[str, bytes]:
        """Of all distinct words of a batch; compute is asked for those that the memo lacks."""
        out, fresh = {}, []
        for word in words:
            value = self.kept.get(word)
            if value is None:
                value = self.young.pop(word, None)
                if value is None:
                    fresh.append(word)
                    continue
                self.kept[word] = value
            out[word] = value
        new = dict(zip(fresh, compute(fresh)))
        if len(self.kept) > self.most:
            self.young, self.kept = self.kept, {}
        if len(self.young) + len(new) > self.most:
            self.young.clear()
        self.young.update((w, v) for w, v in new.items() if len(w) <= 64)
        out.update(new)
        return out
