"""Chat models over HTTP against a server on this machine; tasks by name."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from annolake import chat, providers
from annolake.schema import PREDICATES, valid_relations

TEXT = "paper_id string, location string, text string"


@pytest.fixture
def served():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, {k.lower(): v for k, v in self.headers.items()}, body))
            user = body["messages"][1]["content"]
            busy = user == "busy" and sum(x[2]["messages"][1]["content"] == "busy" for x in seen) < 3
            code = 503 if busy else 400 if user == "refused" else 200
            said = json.dumps({"choices": [{"message": {"content": f"{body['messages'][0]['content']}: {user}"}}]}).encode()
            self.send_response(code)
            self.send_header("Content-Length", str(len(said)))
            self.end_headers()
            self.wfile.write(said)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1", seen
    server.shutdown()


def test_calls_keys_and_tries(served, monkeypatch):
    url, seen = served
    monkeypatch.setenv("GROQ_API_KEY", "from the environment")
    model = providers.build("groq", model="m", base_url=url, wait=0.01, max_new_tokens=7)
    assert model.chat_completion("s", "busy", 0.5) == "s: busy" and len(seen) == 3
    path, head, body = seen[0]
    assert path == "/v1/chat/completions" and head["authorization"] == "Bearer from the environment"
    assert (body["model"], body["temperature"], body["max_tokens"]) == ("m", 0.5, 7)
    with pytest.raises(Exception, match="400"):
        model.chat_completion("s", "refused")
    assert len(seen) == 4  # not tried again
    assert model.chat_all(["s"] * 9, list("abcdefghi"), [0.0] * 9) == [f"s: {c}" for c in "abcdefghi"]
    azure = providers.build("azure", model="d", base_url=url.removesuffix("/v1"), api_key="k", wait=0.01)
    assert azure.chat_completion("s", "x") == "s: x"
    assert seen[-1][0] == "/openai/deployments/d/chat/completions?api-version=2024-02-01" and seen[-1][1]["api-key"] == "k"


def test_registry_has_the_known_servers():
    assert {"openai", "azure", "groq", "together", "lmstudio", "ollama", "huggingface"} <= set(providers.REGISTRY)
    assert providers.build("ollama", model="m").base_url == "http://localhost:11434/v1" and providers.build("lmstudio", model="m").base_url == "http://localhost:1234/v1"
    with pytest.raises(ImportError, match="transformers"):
        providers.build("huggingface", model="m").chat_completion("s", "u")


def test_answers_reach_a_frame(spark, served):
    url, _ = served
    df = spark.createDataFrame([("s", "hello"), ("s", "refused")], "system string, user string").repartition(2)
    found = {r["user"]: (r["response"], (r["failure"] or "")[:9]) for r in providers.answered(df, providers.build("ollama", model="m", base_url=url, wait=0.01)).collect()}
    assert found == {"hello": ("s: hello", ""), "refused": (None, "HTTPError")}


def test_tasks_by_name(spark, tmp_path, served):
    url, _ = served
    texts = spark.createDataFrame([("p", "title", "some longer words here")], TEXT)
    (tmp_path / "prompts.json").write_text(json.dumps({"system_prompts": {"base": "list"}, "user_prompts": {"base": "{text}", "json": '["longer", "words"]{text}'}}))
    ask = {"provider": "Ollama", "model": "m", "base_url": url, "prompts_path": str(tmp_path / "prompts.json"), "user_prompt": "json"}
    found = chat.terms({**ask, "extractor": "llm"}, texts)
    assert sorted(r["text_span"] for r in found.collect()) == ["longer", "words"]
    assert sorted(r["text_span"] for r in chat.terms({"extractor": "HF"}, texts, providers.HashTagger(1)).collect()) == ["here", "longer", "some", "words"]
    assert chat.entities({**ask, "recognizer": "llm"}, texts).count() == 2
    assert chat.entities({"recognizer": "gliner", "threshold": 0.0}, texts, providers.HashSpans(1)).count() > 0
    assert chat.entities({"recognizer": "hf"}, texts, providers.HashTagger(1)).count() == 4
    entity = spark.createDataFrame([("p", "title", 0, 3, "bacteria", 0), ("p", "title", 5, 10, "bacteria", 1)], "paper_id string, location string, start_idx int, end_idx int, label string, ord int")
    assert {r["label"] for r in chat.classes({"classifier": "hf"}, entity, texts, providers.HashClassifier(["food"])).collect()} == {"food"}
    assert chat.relations({}, entity, texts, valid_relations(spark), providers.HashClassifier(PREDICATES)).columns  # hf by default
    for task, key in ((chat.terms, "extractor"), (chat.entities, "recognizer")):
        with pytest.raises(ValueError, match=f"unknown {key}"):
            task({key: "other"}, texts)
    with pytest.raises(ValueError):
        chat.entities({"recognizer": "llm", "provider": "nobody", "model": "m", "system_prompt": "s", "user_prompt": "u"}, texts)
