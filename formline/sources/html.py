"""Lineup pages to rows: one page gives many lineup rows and starter rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline import vocab

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Node:
    def __init__(self, tag: str, attributes: dict, parent: Node | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Node | str] = []
        self.classes = set((attributes.get("class") or "").split())

    def walk(self) -> Iterator[Node]:
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def all(self, *classes: str, tag: str | None = None) -> list[Node]:
        return [n for n in self.walk() if set(classes) <= n.classes and tag in (None, n.tag)]

    def first(self, *classes: str, tag: str | None = None) -> Node | None:
        return next((n for n in self.walk() if set(classes) <= n.classes and tag in (None, n.tag)), None)

    def text(self) -> str:
        parts = [c.strip() if isinstance(c, str) else c.text() for c in self.children]
        return " ".join(p for p in parts if p)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def tree(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def _number(x: str | None) -> int | None:
    try:
        return int(x.strip())
    except (AttributeError, ValueError):
        return None


def _player(plate: Node | None) -> dict:
    """Name, hand and link of a name plate; nothing for one that is missing, blank or to be announced."""
    link = plate.first("player-nameplate-name", tag="a") if plate else None
    name = link.text() if link else ""
    if not name or name.upper() == "TBD":
        return {"player_name": None, "hand": None, "player_path": None}
    stats = plate.first("player-nameplate-stats")
    hand = next((c for c in stats.children if isinstance(c, Node) and c.tag == "span" and "small" in c.classes), None) if stats else None
    return {"player_name": name, "hand": (hand.text().strip("()") or None) if hand else None, "player_path": link.attributes.get("href")}


def _team(node: Node) -> str:
    raw = (node.attributes.get("data-abbr") or "").strip().upper()
    code = vocab.TEAM_ALIASES.get(raw, raw)
    if code not in vocab.TEAM_IDS:
        raise ValueError(f"unknown team code: {raw}")
    return code


def _plates(side: Node) -> Iterator[tuple[str, Node | None]]:
    """The name plates of a side: its pitcher's, which is a child of his box or missing, and one of each listed batter."""
    box = side.first("lineup-card-pitcher")
    own = [c for c in box.children if isinstance(c, Node) and c.tag == "span" and "player-nameplate" in c.classes] if box else []
    yield "starter", own[0] if own else None
    for body in side.all("lineup-card-body")[:1]:
        yield from (("lineup", line.first("player-nameplate", tag="span")) for line in body.all("lineup-card-player", tag="li"))


#: What a batter's plate says beside the player.
_LINE = {
    "batting_order": lambda plate: _number(small.text() if (small := plate.first("small", tag="span")) else None),
    "position": lambda plate: plate.attributes.get("data-position") or None,
    "salary": lambda plate: _number(plate.attributes.get("data-salary")),
}


def _side_rows(side: Node, teams: Sequence[str], is_home: bool) -> Iterator[dict]:
    """Rows of one side of a card whose teams are away and home."""
    codes = dict(zip(("away", "home"), teams, strict=True)) | {"": teams[is_home], "opponent": teams[not is_home]}
    named = {"away_team": "away", "home_team": "home", "team": "", "opponent": "opponent"}
    common = {column: codes[k] for column, k in named.items()}
    common |= {f"{column}_id" if column != "opponent" else "opponent_team_id": vocab.TEAM_IDS[codes[k]] for column, k in named.items()}
    open_ = any("unconfirmed" in body.classes for body in side.all("lineup-card-body")[:1])
    common |= {"is_home": is_home, "lineup_status": "projected" if open_ else "confirmed"}
    for kind, plate in _plates(side):
        line = {c: read(plate) if plate and kind == "lineup" else None for c, read in _LINE.items()}
        yield {**common, "kind": kind, **_player(plate), **line}


def slate_rows(html: str) -> list[dict]:
    """Rows of a page: kind `lineup` for each listed batter, `starter` for each side's pitcher. Cards without two teams and two lineups are skipped."""
    rows: list[dict] = []
    for card in tree(html).all("module", "game-card"):
        titles = [t for box in card.all("game-card-teams")[:1] for t in box.all("team-nameplate-title")]
        sides = [n for box in card.all("game-card-lineups") for n in box.children if isinstance(n, Node) and "lineup-card" in n.classes]
        if len(titles) == len(sides) == 2:
            teams = [_team(t) for t in titles]
            rows += [row for k, side in enumerate(sides) for row in _side_rows(side, teams, bool(k))]
    return rows


_ROWS = "away_team string, home_team string, away_team_id long, home_team_id long, team string, team_id long, opponent string, opponent_team_id long, is_home boolean, lineup_status string, kind string, player_name string, hand string, player_path string, batting_order long, position string, salary long"


def parse_slates(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pages(html, game_date, fetched_at) to (lineups, starters)."""
    kept = [f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("game_date", "fetched_at")]
    names = [x.split()[0] for x in _ROWS.split(", ")]

    def f(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            rows = [{**row, "game_date": r.game_date, "fetched_at": r.fetched_at} for r in df.itertuples() if r.html for row in slate_rows(r.html)]
            out = pd.DataFrame(rows, columns=[*names, "game_date", "fetched_at"])
            yield out.astype({c: "Int64" for c in ("batting_order", "salary")})

    rows = pages.select("html", "game_date", "fetched_at").mapInPandas(f, ", ".join([_ROWS, *kept])).withColumn("source", F.lit("lineup_page"))
    lineups = rows.where("kind = 'lineup'").withColumnsRenamed({"hand": "bats"}).drop("kind")
    starters = rows.where("kind = 'starter'").withColumnsRenamed({"hand": "throws"}).drop("kind", "batting_order", "position", "salary")
    return lineups, starters


def links(pages: DataFrame) -> DataFrame:
    """(page_id, n_links) of anchors with a target, by the parser."""

    def f(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            yield pd.DataFrame({"page_id": df["page_id"], "n_links": [sum(1 for n in tree(h or "").walk() if n.tag == "a" and n.attributes.get("href")) for h in df["html"]]})

    return pages.select("page_id", "html").mapInPandas(f, "page_id long, n_links long")
