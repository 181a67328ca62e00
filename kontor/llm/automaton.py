"""A lexicon trie intersected with Levenshtein automata.

The trie holds words and stems.  A state of the intersection is the set of (trie node, edits)
that can be reached with the letters read so far; states are made when a word first needs
them, so that words share their beginnings, and a word is left at the letter at which no node
is in reach.  Entries of up to ``SHORT`` letters have to match letter by letter, those of
``LONG`` or more may differ in two edits, others in one.  Stems match a word's beginning
without edits.
"""

from __future__ import annotations

SHORT, LONG = 3, 8
#: States and words that are remembered; beyond these the memory is emptied, results stay the same.
STATES, WORDS = 200_000, 400_000


def edits_allowed(entry: str) -> int:
    return 0 if len(entry) <= SHORT else 2 if len(entry) >= LONG else 1


class Lexicon(dict):
    """Maps a word to (entry, edits), to None without an entry in reach; ``entries`` are (text, is_stem)."""

    def __init__(self, entries: list[tuple[str, bool]]):
        super().__init__()
        self.entries = entries
        self.children: list[dict[str, int]] = [{}]
        self.budget, self.word, self.stem = [0], [-1], [-1]
        for i, (text, is_stem) in enumerate(entries):
            node, allowed = 0, 0 if is_stem else edits_allowed(text)
            self.budget[0] = max(self.budget[0], allowed)
            for letter in text:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.budget.append(0)
                    self.word.append(-1)
                    self.stem.append(-1)
                node = self.children[node][letter]
                self.budget[node] = max(self.budget[node], allowed)
            (self.stem if is_stem else self.word)[node] = i
        self._restart()

    def _restart(self) -> None:
        self.number: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.stems: list[int] = []
        self.start = self._state({(0, 0)})

    def _state(self, reached: set[tuple[int, int]]) -> int:
        """The state's number, -1 if nothing is in reach; letters of the entry that the word lacks are added."""
        open_, best = list(reached), dict()
        while open_:
            node, edits = open_.pop()
            if edits > self.budget[node] or best.get(node, 9) <= edits:
                continue
            best[node] = edits
            open_ += [(child, edits + 1) for child in self.children[node].values()]
        if not best:
            return -1
        key = frozenset(best.items())
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            ends = [(e, self.word[n]) for n, e in key if self.word[n] >= 0 and e <= edits_allowed(self.entries[self.word[n]][0])]
            self.accepts.append(min(ends, default=None))
            self.stems.append(max((self.stem[n] for n, e in key if e == 0 and self.stem[n] >= 0), default=-1))
        return self.number[key]

    def _step(self, state: int, letter: str) -> int:
        reached = set()
        for node, edits in self.states[state]:
            for other, child in self.children[node].items():
                reached.add((child, edits + (other != letter)))
            reached.add((node, edits + 1))
        return self._state(reached)

    def __missing__(self, word: str) -> tuple[int, int] | None:
        if len(self) > WORDS:
            self.clear()
        if len(self.states) > STATES:
            self._restart()
        state, stem = self.start, -1
        for letter in word:
            following = self.steps[state].get(letter)
            if following is None:
                following = self.steps[state][letter] = self._step(state, letter)
            state = following
            if state < 0:
                break
            if self.stems[state] >= 0:
                stem = self.stems[state]
        found = self.accepts[state] if state >= 0 else None
        hit = (found[1], found[0]) if found and (found[0] == 0 or stem < 0) else (stem, 0) if stem >= 0 else None
        self[word] = hit
        return hit
