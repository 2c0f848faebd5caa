"""Readers by id, keys, chat connectors and messages."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest

from scenewright.sources import files, providers, sinks


def test_point_lookup_and_later_suffix(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.array([[1.0, 2, 3], [4, 5, 6]]))
    (tmp_path / "a.ply").write_text("ply\nformat ascii 1.0\nelement vertex 1\nend_header\n7 8 9 255 0 0\n")
    np.save(tmp_path / "b.npy", np.array([[0.0, 0, 0]]))
    folder = f"file://{tmp_path}"
    assert [(r.x, r.y, r.z, r.r) for r in files.read_cloud(spark, folder, "a").orderBy("pt").collect()] == [(1, 2, 3, None), (4, 5, 6, None)]
    with pytest.raises(FileNotFoundError, match="'c'"):
        files.read_cloud(spark, folder, "c")
    assert sorted((r.cloud_id, r.x, r.r) for r in files.read_points(spark, folder).collect()) == [("a", 7, 1.0), ("b", 0, None)]
    assert {r.cloud_id: r.path.rsplit(".", 1)[1] for r in files.list_clouds(spark, folder).collect()} == {"a": "ply", "b": "npy"}
    with pytest.raises(IndexError):
        sinks.export_cloud(files.read_points(spark, folder).filter("cloud_id = 'none'"), f"{folder}/x.npy")


def test_points_of_many_kinds(tmp_path):
    p = np.eye(3)
    np.save(tmp_path / "p.npy", p)

    class Tensor:
        def cpu(self):
            return self

        def numpy(self):
            return p

    for data in (p, Tensor(), str(tmp_path / "p.npy")):
        assert (files.as_points(data) == p).all()
    for data in (3, "nothing.npy", [1, 2]):
        with pytest.raises(ValueError):
            files.as_points(data)


def test_keys_and_pool():
    assert providers.read_keys("other: 1\nkeys:\n  - 'a'\n  - b # second\nmore: x\n") == ["a", "b"] == providers.read_keys("keys: [a, 'b']")
    with pytest.raises(ValueError):
        providers.read_keys("nothing: 1")
    pool, seen, most = providers.KeyPool(["a", "b"], limit=2, seed=1), [], []
    gate = threading.Barrier(4)

    def call(key):
        seen.append(key)
        gate.wait(5)
        most.append(max(pool.busy))
        return key

    threads = [threading.Thread(target=pool.run, args=(call,)) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(seen) == ["a", "a", "b", "b"] and max(most) <= 2 and pool.busy == [0, 0] and pool.calls == [2, 2]
    with pytest.raises(OSError):
        pool.run(lambda key: (_ for _ in ()).throw(OSError()))
    assert pool.errors == 1 and pool.busy == [0, 0]


def test_chat_connector():
    got = []

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            got.append((self.headers["Authorization"], body))
            said = json.dumps({"choices": [{"message": {"content": "yes", "reasoning_content": "because"}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(said)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/chat"
    assert providers.Chat(url, "some-model", ["k1"])("hello") == "yes"
    assert providers.Chat(url, "DeepSeek-R1", ["k2"], system="s").reply("hi") == {"answer": "yes", "rational": "because"}
    server.shutdown()
    assert got[0][0] == "Bearer k1" and [m["role"] for m in got[0][1]["messages"]] == ["system", "user"] and got[0][1]["stream"] is False
    assert got[1][1]["messages"][-1] == {"role": "assistant", "content": "<think>\n"} and got[1][1]["messages"][0]["content"] == "s"
    parts = providers.content([{"type": "video", "frames": [b"ab", b"c"]}, {"type": "text", "text": "?"}])
    assert parts == [{"type": "video_url", "video_url": {"url": "data:video/jpeg;base64,YWI=,Yw=="}}, {"type": "text", "text": "?"}]
    with pytest.raises(NotImplementedError):
        providers.content([{"type": "image"}])


def test_video_url_of_a_table(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(["x" * 100, "y"],)], "f array<string>").select(providers.video_url(F.transform("f", lambda x: F.encode(x, "utf-8"))).alias("u"))
    url = rows.first().u
    assert url.startswith("data:video/jpeg;base64,") and "\n" not in url and url.count(",") == 2


def test_slow_calls_hold_no_others_back(spark):
    rows = spark.createDataFrame([(i, f"p{i}") for i in range(30)], "id long, prompt string").coalesce(1)

    def call(prompt):
        import time

        time.sleep(0.3 if prompt == "p0" else 0)
        return prompt

    got = [r.id for r in providers.ask(rows, call, concurrency=2, wait=0.0).collect()]
    assert sorted(got) == list(range(30)) and got[0] != 0


def test_scene_system_prompt_examples_are_valid():
    examples = [x for x in providers.SYSTEM.splitlines() if x.startswith("{")]
    assert len(examples) == 3 and all(providers.valid_scene(x) for x in examples) and not providers.valid_scene("{}") and not providers.valid_scene(None)
