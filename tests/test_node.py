import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from chainloom.plans.fetch import Span
from chainloom.sources import blocks, node
from chainloom.sources.node import Bulk, Inconsistent, Node, Refused, http_calls, http_query

BLOOM = "0x" + "1" * 512


def logs_of(h):
    return [] if h % 3 == 0 else [{"blockNumber": hex(h), "blockHash": f"h{h}", "logIndex": hex(i), "transactionHash": f"t{h}", "transactionIndex": "0x0", "address": f"0x{i}", "topics": [f"e{h % 2}"], "data": "0x"} for i in range(2)]


def header_of(h, full=False):
    t = {"hash": f"t{h}", "from": "0xf", "to": None, "input": "0x"}
    return {"number": hex(h), "hash": f"h{h}", "parentHash": f"h{h - 1}", "timestamp": hex(100 + h), "logsBloom": BLOOM if logs_of(h) else node.NO_BLOOM, "transactions": [t] if full else [t["hash"]]}


class Recorded:
    """A node with 30 blocks that refuses ranges of more than ``most`` heights; ``bad`` answers go out instead."""

    def __init__(self, most=4, receipts=True, bad=None):
        self.most, self.receipts, self.bad, self.asked = most, receipts, bad or {}, []

    def __call__(self, calls):
        self.asked.append([m for m, _ in calls])
        return [self.bad[m] if m in self.bad else getattr(self, m)(*p) for m, p in calls]

    def eth_blockNumber(self):
        return hex(29)

    def eth_getBlockByNumber(self, height, full):
        return header_of(int(height, 16), full)

    def eth_getLogs(self, f):
        if "blockHash" in f:
            return logs_of(int(f["blockHash"][1:]))
        low, high = int(f["fromBlock"], 16), int(f["toBlock"], 16)
        return Refused(-32005, "too many results") if high - low >= self.most else [x for h in range(low, high + 1) for x in logs_of(h)]

    def eth_getBlockReceipts(self, height):
        h = int(height, 16)
        return [{"transactionHash": f"t{h}", "logs": logs_of(h)}] if self.receipts else Refused(node.NO_METHOD, "no method")

    def eth_getTransactionReceipt(self, hash_):
        return {"transactionHash": hash_, "logs": logs_of(int(hash_[1:]))}


def made(**kw):
    transactions = kw.pop("transactions", False)
    ask = Recorded(**kw)
    return ask, Node(ask, transactions, Span(now=16, most=16), sleep=lambda s: None)


def test_ranges_are_halved_until_they_are_served():
    ask, n = made()
    got = list(n.range(0, 29))
    assert [b["height"] for b in got] == list(range(30)) and n.span.now <= 4
    assert [len(b["logs"]) for b in got] == [len(logs_of(h)) for h in range(30)]
    assert n.head() == 29 and n.header(7)["parent_hash"] == "h6"


def test_a_single_height_that_fails_is_an_error():
    _, n = made(most=0)
    with pytest.raises(OSError, match="too many"):
        list(n.range(0, 3))


@pytest.mark.parametrize("height,bad,problem", [(4, logs_of(4)[::-1], "order"), (3, logs_of(4), "behind"), (4, [], "bloom"), (4, [logs_of(4)[0] | {"blockHash": "x"}], "another block"), (4, None, "not served")])
def test_wrong_answers_are_refused_and_not_asked_again(height, bad, problem):
    ask, n = made(bad={"eth_getLogs": bad})
    with pytest.raises(Inconsistent, match=problem):
        list(n.range(height, height))
    assert len(ask.asked) == 1


def test_an_announced_head_saves_its_header_unless_it_has_no_logs():
    ask, n = made()
    head = {"height": 4, "hash": "h4", "parent_hash": "h3", "timestamp": 104}
    assert n.block(4, head) == next(n.range(4, 4)) and ask.asked[0] == ["eth_getLogs"]
    ask.asked.clear()
    assert n.block(6, head | {"height": 6, "hash": "h6"})["logs"] == []
    assert ask.asked == [["eth_getLogs"], ["eth_getBlockByNumber", "eth_getLogs"]]
    assert n.block(5, head)["hash"] == "h5"  # a head of another height is no use


@pytest.mark.parametrize("receipts", [True, False])
def test_whole_blocks_with_receipts_at_once_or_one_by_one(receipts):
    ask, n = made(receipts=receipts, transactions=True)
    got = list(n.range(4, 6))
    assert [len(b["logs"]) for b in got] == [2, 2, 0] and got[0]["transactions"][0]["from_address"] == "0xf"
    assert ask.asked[0] == ["eth_getBlockByNumber", "eth_getBlockReceipts"]
    assert (["eth_getTransactionReceipt"] in ask.asked) is not receipts


class Pages:
    """A bulk endpoint that answers three heights at a time, and reaches 20 at first."""

    def __init__(self, reached=29):
        self.reached, self.asked, self.waited = reached, [], []

    def __call__(self, q):
        self.asked.append(q)
        low, high = q["from_block"], min(q["to_block"] - 1, q["from_block"] + 2, self.reached)
        logs = [x for h in range(low, high + 1) for x in logs_of(h)]
        for selection in q.get("logs", [])[:1]:
            logs = [x for x in logs if x["address"] in selection.get("address", [x["address"]]) and x["topics"][0] in selection.get("topics", [x["topics"]])[0]]
        rows = [{"block_number": int(x["blockNumber"], 16), "block_hash": x["blockHash"], "log_index": int(x["logIndex"], 16), "transaction_hash": x["transactionHash"], "transaction_index": 0, "address": x["address"], "topic0": x["topics"][0], "data": "0x"} for x in logs]
        wanted = range(low, high + 1) if q.get("include_all_blocks") else sorted({r["block_number"] for r in rows})
        heads = [{"number": h, "hash": f"h{h}", "parent_hash": f"h{h - 1}", "timestamp": 100 + h, "logs_bloom": header_of(h)["logsBloom"]} for h in wanted]
        sent = [{"block_number": h, "transaction_index": 0, "hash": f"t{h}", "from": "0xf", "to": None, "input": "0x"} for h in wanted] if "transactions" in q else []
        return {"data": [{"blocks": heads, "logs": rows, "transactions": sent}], "next_block": high + 1, "archive_height": self.reached}

    def sleep(self, seconds):
        self.waited.append(seconds)
        self.reached = 29


def test_bulk_ranges_are_paged_and_equal_a_node_s():
    pages = Pages()
    got = list(Bulk(pages, transactions=True).range(2, 12))
    assert [{k: v for k, v in b.items() if k != "transactions"} for b in got] == list(made()[1].range(2, 12))
    assert len(pages.asked) == 4 and got[0]["transactions"][0]["hash"] == "t2"
    assert Bulk(pages).head() == 29 and Bulk(pages).header(7)["hash"] == "h7"


def test_a_search_waits_for_an_endpoint_that_is_behind():
    pages = Pages(reached=10)
    got = list(Bulk(pages, sleep=pages.sleep).search(0, 29, ["0x1"], ["e1"]))
    assert [(x["block_number"], x["log_index"]) for x in got] == [(h, 1) for h in range(30) if h % 3 and h % 2]
    assert pages.waited == [node.BEHIND]


def test_a_page_that_does_not_move_on_is_refused():
    with pytest.raises(Inconsistent, match="move on"):
        list(Bulk(lambda q: {"data": [], "next_block": q["from_block"]}).range(0, 3))


@pytest.fixture(scope="module")
def served():
    """Both kinds of endpoints over HTTP on this machine; the first request of all is told to come again."""
    recorded, pages, busy = Recorded(), Pages(), [True]

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if busy.pop() if busy else False:
                self.send_response(429)
                self.send_header("Retry-After", "0")
                self.end_headers()
                return
            if isinstance(body, list):
                found = [(c["id"], recorded([(c["method"], c["params"])])[0]) for c in body]
                answer = [{"id": i, "error": {"code": a.code, "message": str(a)}} if isinstance(a, Refused) else {"id": i, "result": a} for i, a in reversed(found)]
            else:
                answer = pages(body)
            out = json.dumps(answer).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/"
    server.shutdown()


def test_tasks_read_blocks_and_logs_over_http(spark, served):
    assert Node(http_calls(served), sleep=lambda s: None).head() == 29  # after one refusal
    assert Bulk(http_query(served, "token")).head() == 29
    blocks.register(spark)
    got = spark.read.format("chain_blocks").options(client="chainloom.sources.node:node", url=served, span="8").option("to", "19").load()
    assert sorted((r.height, r.hash) for r in got.collect()) == [(h, f"h{h}") for h in range(20)]
    found = spark.read.format("chain_logs").options(client="chainloom.sources.node:bulk", url=served, to="29", span="10").load()
    want = sorted((h, i) for h in range(30) if h % 3 for i in range(2))
    assert sorted((r.block_number, r.log_index) for r in found.collect()) == want
    one = found.where("address = '0x1' and topic0 in ('e1')")
    assert sorted(r.block_number for r in one.collect()) == [h for h in range(30) if h % 3 and h % 2]
    both = spark.read.format("chain_logs").options(client="chainloom.sources.node:bulk", url=served, to="29", address="0x0").load()
    assert both.where("address = '0x1'").count() == 0
