"""Clients of nodes and of bulk endpoints, behind a transport that is handed in.

``Node`` speaks Ethereum's JSON-RPC, ``Bulk`` a paged JSON query over ranges of blocks. Both give blocks in the shape of
``sources.blocks``, so ``chain_blocks`` reads from either, one task for each range. Answers are checked, not mended: what
a node got wrong is ``Inconsistent``, what did not arrive is an ``OSError``, and only the latter is asked again.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

from chainloom.plans.fetch import Pace, Span, chunks, retried, spanned

#: JSON-RPC's code for a method that a node does not have.
NO_METHOD = -32601
NO_BLOOM = "0x" + "0" * 512
#: Seconds between questions to an endpoint that has not reached the wanted height.
BEHIND = 300.0


class Inconsistent(ValueError):
    """An answer that contradicts the question or itself."""


class Refused(ValueError):
    """An answer that is an error of the node's."""

    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def number(quantity: str | int) -> int:
    return quantity if isinstance(quantity, int) else int(quantity, 16)


def _post(url: str, body: object, headers: dict[str, str], timeout: float) -> object:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.load(answer)
    except urllib.error.HTTPError as error:
        if error.code != 429 and error.code < 500:
            raise Refused(error.code, str(error)) from None
        again = error.headers.get("Retry-After", "")
        failure = OSError(str(error))
        failure.retry_after = float(again) if again.isdigit() else None
        raise failure from None


def http_calls(url: str, timeout: float = 30.0, **headers: str) -> Callable[[list[tuple[str, list]]], list]:
    """A transport of JSON-RPC batches over HTTP: results in the order of the calls, ``Refused`` in place of errors."""

    def ask(calls: list[tuple[str, list]]) -> list:
        body = [{"jsonrpc": "2.0", "id": i, "method": m, "params": p} for i, (m, p) in enumerate(calls)]
        answers = _post(url, body, headers, timeout)
        by_id = {a["id"]: a for a in answers} if isinstance(answers, list) else {}
        if by_id.keys() != set(range(len(calls))):
            raise Inconsistent("a batch whose answers do not fit its calls")
        return [Refused(by_id[i]["error"]["code"], by_id[i]["error"]["message"]) if "error" in by_id[i] else by_id[i].get("result") for i in range(len(calls))]

    return ask


def http_query(url: str, token: str, timeout: float = 60.0) -> Callable[[dict], dict]:
    """A transport of bulk queries over HTTP."""
    return lambda query: _post(url, query, {"Authorization": f"Bearer {token}"}, timeout)


def meta(header: dict) -> dict:
    return {"height": number(header["number"]), "hash": header["hash"], "parent_hash": header["parentHash"], "timestamp": number(header["timestamp"])}


def log(raw: dict) -> dict:
    return {
        "log_index": number(raw["logIndex"]),
        "transaction_hash": raw["transactionHash"],
        "transaction_index": number(raw["transactionIndex"]),
        "address": raw["address"],
        "topics": raw["topics"],
        "data": raw["data"],
    }


def assigned(low: int, headers: list[dict], logs: list[dict]) -> list[tuple[dict, list[dict]]]:
    """(header, its logs) of a range: logs come as runs of the heights in order, each with ascending indexes."""
    runs = [(h, list(g)) for h, g in groupby(logs, lambda x: number(x["blockNumber"]))]
    out, at = [], 0
    for height, header in enumerate(headers, low):
        if number(header["number"]) != height:
            raise Inconsistent(f"block {header['number']} instead of {height}")
        own: list[dict] = []
        if at < len(runs) and runs[at][0] == height:
            own, at = runs[at][1], at + 1
        places = [number(x["logIndex"]) for x in own]
        if any(b <= a for a, b in zip(places, places[1:], strict=False)):
            raise Inconsistent(f"logs of {height} out of order")
        if any(x["blockHash"] != header["hash"] for x in own):
            raise Inconsistent(f"logs of another block at {height}")
        if not own and header.get("logsBloom", NO_BLOOM) != NO_BLOOM:
            raise Inconsistent(f"no logs of {height}, but its bloom has some")
        out.append((header, own))
    if at < len(runs):
        raise Inconsistent(f"logs of {runs[at][0]} behind their place")
    return out


@dataclass
class Node:
    """Blocks of a node. With ``transactions`` a height takes a block with its receipts, else ranges of logs suffice."""

    ask: Callable[[list[tuple[str, list]]], list]
    transactions: bool = False
    span: Span = field(default_factory=Span)
    pace: Pace = field(default_factory=Pace)
    sleep: Callable[[float], None] = time.sleep

    def _ask(self, calls: list[tuple[str, list]]) -> list:
        return retried(lambda: self.ask(calls), self.pace, sleep=self.sleep)

    def _served(self, calls: list[tuple[str, list]]) -> list:
        answers = self._ask(calls)
        for (method, _), a in zip(calls, answers, strict=True):
            if isinstance(a, Refused):
                raise OSError(f"{method}: {a}") from a  # a range may be too wide; a smaller one is asked for
            if a is None:
                raise Inconsistent(f"{method}: not served")
        return answers

    def head(self) -> int:
        return number(self._served([("eth_blockNumber", [])])[0])

    def header(self, height: int) -> dict:
        found = meta(self._served([("eth_getBlockByNumber", [hex(height), False])])[0])
        if found["height"] != height:
            raise Inconsistent(f"block {found['height']} instead of {height}")
        return found

    def range(self, low: int, high: int) -> Iterator[dict]:
        """Blocks of [low, high] by height; ranges that fail are asked again in smaller ones, down to a height."""
        if self.transactions:
            yield from map(self.whole, range(low, high + 1))
            return
        for _, _, blocks in spanned(self._range, low, high, self.span):
            yield from blocks

    def _range(self, low: int, high: int) -> list[dict]:
        calls = [("eth_getBlockByNumber", [hex(h), False]) for h in range(low, high + 1)]
        *headers, logs = self._served([*calls, ("eth_getLogs", [{"fromBlock": hex(low), "toBlock": hex(high)}])])
        return [meta(h) | {"logs": [log(x) for x in own]} for h, own in assigned(low, headers, logs)]

    def block(self, height: int, head: dict | None = None) -> dict:
        """One block. A head of that height that was announced saves its header, unless there are no logs: then the bloom decides."""
        if head and head["height"] == height and not self.transactions:
            logs = self._served([("eth_getLogs", [{"blockHash": head["hash"]}])])[0]
            if logs:
                announced = {"number": hex(height), "hash": head["hash"]}
                return head | {"logs": [log(x) for x in assigned(height, [announced], logs)[0][1]]}
        return next(self.range(height, height))

    def whole(self, height: int) -> dict:
        """A block with transactions and receipts, from one batch of two calls."""
        block, receipts = self._ask([("eth_getBlockByNumber", [hex(height), True]), ("eth_getBlockReceipts", [hex(height)])])
        if isinstance(block, Refused):
            raise OSError(str(block)) from block
        if block is None or number(block["number"]) != height:
            raise Inconsistent(f"no block {height}")
        if isinstance(receipts, Refused) and receipts.code != NO_METHOD:
            raise OSError(str(receipts)) from receipts
        if receipts is None or isinstance(receipts, Refused):
            receipts = self._receipts([t["hash"] for t in block["transactions"]])
        if [r["transactionHash"] for r in receipts] != [t["hash"] for t in block["transactions"]]:
            raise Inconsistent(f"receipts of {height} do not fit its transactions")
        logs = [x for r in receipts for x in r["logs"]]
        ((_, own),) = assigned(height, [block], logs)
        sent = [{"hash": t["hash"], "from_address": t["from"], "to_address": t["to"], "input": t["input"]} for t in block["transactions"]]
        return meta(block) | {"transactions": sent, "logs": [log(x) for x in own]}

    def _receipts(self, hashes: list[str]) -> list[dict]:
        return [r for part in chunks(hashes) for r in self._served([("eth_getTransactionReceipt", [h]) for h in part])]


#: What a bulk query selects.
BULK_BLOCK = ("number", "hash", "parent_hash", "timestamp", "logs_bloom")
BULK_TRANSACTION = ("block_number", "transaction_index", "hash", "from", "to", "input")
BULK_LOG = ("block_number", "block_hash", "log_index", "transaction_index", "transaction_hash", "address", "topic0", "topic1", "topic2", "topic3", "data")


@dataclass
class Bulk:
    """Blocks and logs of an endpoint that answers queries over ranges in pages, each as far as it gets."""

    query: Callable[[dict], dict]
    transactions: bool = False
    pace: Pace = field(default_factory=Pace)
    sleep: Callable[[float], None] = time.sleep

    def _pages(self, low: int, high: int, question: dict, wait: bool) -> Iterator[dict]:
        """Batches of the pages from ``low`` to ``high``."""
        at = low
        while at <= high:
            asked = {"from_block": at, "to_block": high + 1, **question}
            answer = retried(lambda asked=asked: self.query(asked), self.pace, sleep=self.sleep)
            yield from answer["data"]
            reached, after = answer.get("archive_height"), answer["next_block"]
            if wait and reached is not None and reached < high and after > reached:
                at = max(at, reached + 1)
                self.sleep(BEHIND)
                continue
            if after <= at:
                raise Inconsistent("a page that does not move on")
            at = after

    def head(self) -> int:
        return retried(lambda: self.query({"from_block": 0, "to_block": 1, "field_selection": {"block": ["number"]}}), self.pace, sleep=self.sleep)["archive_height"]

    def header(self, height: int) -> dict:
        question = {"include_all_blocks": True, "join_mode": "JoinNothing", "field_selection": {"block": list(BULK_BLOCK)}}
        found = [self._header(b) for batch in self._pages(height, height, question, False) for b in batch.get("blocks", [])]
        if [number(b["number"]) for b in found] != [height]:
            raise Inconsistent(f"no block {height}")
        return meta(found[0])

    def range(self, low: int, high: int) -> Iterator[dict]:
        """Blocks of [low, high] by height, each with its logs, and transactions if wanted."""
        question = {"include_all_blocks": True, "join_mode": "JoinNothing", "logs": [{}], "field_selection": {"block": list(BULK_BLOCK), "log": list(BULK_LOG)}}
        if self.transactions:
            question |= {"transactions": [{}], "field_selection": question["field_selection"] | {"transaction": list(BULK_TRANSACTION)}}
        headers, logs, sent = [], [], []
        for batch in self._pages(low, high, question, False):
            headers += [self._header(b) for b in batch.get("blocks", [])]
            logs += [self._log(x) for x in batch.get("logs", [])]
            sent += batch.get("transactions", [])
        if len(headers) != high - low + 1:
            raise Inconsistent(f"{len(headers)} blocks of {low} to {high}")
        by_block = {h: list(g) for h, g in groupby(sorted(sent, key=lambda t: (t["block_number"], t["transaction_index"])), lambda t: t["block_number"])}
        for header, own in assigned(low, headers, logs):
            block = meta(header) | {"logs": [log(x) for x in own]}
            if self.transactions:
                block["transactions"] = [{"hash": t["hash"], "from_address": t["from"], "to_address": t.get("to"), "input": t["input"]} for t in by_block.get(block["height"], [])]
            yield block

    def search(self, low: int, high: int, addresses: list[str], topics: list[str]) -> Iterator[dict]:
        """Logs of [low, high] of some addresses and selectors (none: all), in chain order, each with its block's time.

        An endpoint that is behind is waited for. A page is sorted by itself; pages follow each other by height.
        """
        selection: dict = {"address": addresses} if addresses else {}
        selection |= {"topics": [topics]} if topics else {}
        question = {"logs": [selection], "field_selection": {"block": ["number", "hash", "timestamp"], "log": list(BULK_LOG)}}
        for batch in self._pages(low, high, question, True):
            times = {number(b["number"]): number(b["timestamp"]) for b in batch.get("blocks", [])}
            for x in sorted((self._log(x) for x in batch.get("logs", [])), key=lambda x: (number(x["blockNumber"]), number(x["logIndex"]))):
                height = number(x["blockNumber"])
                if height not in times:
                    raise Inconsistent(f"a log of {height} without its block")
                yield log(x) | {"block_number": height, "block_hash": x["blockHash"], "block_timestamp": times[height]}

    @staticmethod
    def _header(b: dict) -> dict:
        return {"number": b["number"], "hash": b["hash"], "parentHash": b["parent_hash"], "timestamp": b["timestamp"], "logsBloom": b.get("logs_bloom") or NO_BLOOM}

    @staticmethod
    def _log(x: dict) -> dict:
        topics = [x.get(f"topic{i}") for i in range(4)]
        return {
            "blockNumber": x["block_number"],
            "blockHash": x["block_hash"],
            "logIndex": x["log_index"],
            "transactionHash": x["transaction_hash"],
            "transactionIndex": x["transaction_index"],
            "address": x["address"],
            "topics": [t for t in topics if t is not None],
            "data": x["data"],
        }


def node(options: dict) -> Node:
    """For the option ``client`` of a source: a node at ``url``."""
    return Node(http_calls(options["url"]), options.get("transactions") == "true", Span(most=int(options.get("span", 100))))


def bulk(options: dict) -> Bulk:
    """For the option ``client`` of a source: a bulk endpoint at ``url`` with ``token``."""
    return Bulk(http_query(options["url"], options.get("token", "")), options.get("transactions") == "true")
