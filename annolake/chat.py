"""Chat models over HTTP, and tasks by name: what settings call becomes operators on DataFrames.

A model is sent to the workers as its settings; keys come from the environment there, unless
given. A list of prompts is asked with a few calls in flight, and a call that a server turns
away for now is tried again later.
"""

from __future__ import annotations

import importlib
import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolake import providers
from annolake.config import required
from annolake.providers import register
from annolake.sources.files import read_prompts

#: Where well-known servers are, and which variable holds their key (none is needed on the own machine).
SERVERS = {
    "openai": ("https://api.openai.com/v1", "OPENAI_API_KEY"),
    "groq": ("https://api.groq.com/openai/v1", "GROQ_API_KEY"),
    "together": ("https://api.together.xyz/v1", "TOGETHER_API_KEY"),
    "lmstudio": ("http://localhost:1234/v1", None),
    "ollama": ("http://localhost:11434/v1", None),
}
#: Answers that tell a caller to come again.
AGAIN = (408, 429, 500, 502, 503, 504)


@dataclass
class HttpChat:
    """A server with chat completions. model, or deployment on azure; in_flight: calls at once from a worker."""

    model: str
    base_url: str
    key_name: str | None = None
    api_key: str | None = None
    max_new_tokens: int = 512
    in_flight: int = 4
    tries: int = 4
    wait: float = 1.0
    timeout: float = 120.0

    def request(self, system: str, user: str, temperature: float) -> urllib.request.Request:
        body = {"model": self.model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}], "temperature": temperature, "max_tokens": self.max_new_tokens}
        key = self.api_key or os.environ.get(self.key_name or "") or "none"
        return urllib.request.Request(self.place(), json.dumps(body).encode(), {"Content-Type": "application/json", **self.head(key)})

    def place(self) -> str:
        return f"{self.base_url.rstrip('/')}/chat/completions"

    def head(self, key: str) -> dict[str, str]:
        return {"Authorization": f"Bearer {key}"}

    def chat_completion(self, system: str, user: str, temperature: float = 1.0) -> str:
        for k in range(self.tries):
            try:
                with urllib.request.urlopen(self.request(system, user, temperature), timeout=self.timeout) as said:
                    return json.load(said)["choices"][0]["message"]["content"]
            except urllib.error.HTTPError as x:
                if x.code not in AGAIN or k + 1 == self.tries:
                    raise
            except (urllib.error.URLError, TimeoutError):
                if k + 1 == self.tries:
                    raise
            time.sleep(self.wait * 2**k)
        raise ValueError("tries must be 1 or more")

    def chat_all(self, systems: list[str], users: list[str], temperatures: list[float]) -> list[str]:
        with ThreadPoolExecutor(self.in_flight) as pool:
            return list(pool.map(self.chat_completion, systems, users, temperatures))


@dataclass
class AzureChat(HttpChat):
    """A deployment on azure; base_url: the endpoint, else AZURE_OPENAI_ENDPOINT where it is called."""

    base_url: str = ""
    key_name: str | None = "AZURE_OPENAI_API_KEY"
    api_version: str = "2024-02-01"

    def place(self) -> str:
        return f"{(self.base_url or os.environ['AZURE_OPENAI_ENDPOINT']).rstrip('/')}/openai/deployments/{self.model}/chat/completions?api-version={self.api_version}"

    def head(self, key: str) -> dict[str, str]:
        return {"api-key": key}


def server(name: str) -> Callable[..., HttpChat]:
    """A provider of the registry by the server's name; the default place unless base_url is given."""

    def make(model: str, base_url: str | None = None, **more) -> HttpChat:
        return HttpChat(model, base_url or SERVERS[name][0], SERVERS[name][1], **more)

    return make


for _name in SERVERS:
    register(_name)(server(_name))
register("azure")(AzureChat)


@register("huggingface")
@dataclass
class LocalChat:
    """A causal model run on the workers by the transformers package, loaded once a worker."""

    model: str
    device: str | None = None
    max_new_tokens: int = 512
    top_p: float = 1.0

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "loaded"}

    def load(self):
        if "loaded" not in self.__dict__:
            try:
                transformers = importlib.import_module("transformers")
            except ImportError as x:
                raise ImportError("the provider huggingface needs the package transformers") from x
            self.loaded = transformers.pipeline("text-generation", self.model, device=self.device)
        return self.loaded

    def chat_completion(self, system: str, user: str, temperature: float = 1.0) -> str:
        talk = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        some = {"do_sample": True, "temperature": temperature, "top_p": self.top_p} if temperature > 0 else {"do_sample": False}
        return self.load()(talk, max_new_tokens=self.max_new_tokens, return_full_text=False, **some)[0]["generated_text"]


# --- tasks by name


def chat_of(config: dict) -> tuple[object, str, str, float]:
    """(provider, system prompt, user template, temperature) that settings ask for."""
    required(config, ["provider", "model"])
    more = {k: config[k] for k in ("base_url", "api_key", "max_new_tokens", "device", "api_version") if config.get(k) is not None}
    if config.get("prompts_path"):
        system, template = read_prompts(config["prompts_path"], config.get("system_prompt", "base"), config.get("user_prompt", "base"))
    else:
        required(config, ["system_prompt", "user_prompt"])
        system, template = config["system_prompt"], config["user_prompt"]
    return providers.build(config["provider"].lower(), model=config["model"], **more), system, template, float(config.get("temperature", 1.0))


def talk(config: dict, model) -> tuple[object, str, str, float]:
    """As `chat_of`; with a model of one's own, only prompts and temperature come from the settings."""
    if model is None:
        return chat_of(config)
    required(config, ["system_prompt", "user_prompt"])
    return model, config["system_prompt"], config["user_prompt"], float(config.get("temperature", 1.0))


def choose(config: dict, key: str, kinds: dict[str, Callable], default: str | None = None) -> Callable:
    """The kind that a setting names; an unknown one is an error that lists what there is."""
    name = str(config.get(key) or default or "").lower()
    if name not in kinds:
        raise ValueError(f"unknown {key} {name!r} in the settings; known: {', '.join(kinds)}")
    return kinds[name]


def terms(config: dict, texts: DataFrame, model=None) -> DataFrame:
    """Term extraction by `extractor`: hf (a tagger is given as model) or llm."""

    def llm() -> DataFrame:
        chat, system, template, temperature = talk(config, model)
        said = providers.parsed_terms(providers.asked(texts.select("paper_id", "location", "text"), chat, system, template, temperature))
        named = said.select("paper_id", "location", F.explode("terms").alias("term")).distinct()
        return providers.anchored(named, texts).drop("term").withColumns({"label": F.lit("term"), "confscore": F.lit(providers.NO_SCORE)})

    return choose(config, "extractor", {"hf": lambda: providers.extract_terms(texts, model), "llm": llm})()


def entities(config: dict, texts: DataFrame, model=None) -> DataFrame:
    """Joint recognition by `recognizer`: hf (a tagger), llm or gliner (a span provider, with `threshold`)."""
    llm = lambda: providers.llm_entities(texts, *talk(config, model))
    spans = lambda: providers.extract_spans(texts, model, float(config.get("threshold", 0.5)))
    return choose(config, "recognizer", {"hf": lambda: providers.extract_entities(texts, model), "llm": llm, "gliner": spans})()


def classes(config: dict, entities: DataFrame, texts: DataFrame, model=None) -> DataFrame:
    """Term classification by `classifier`: hf (a classifier) or llm."""
    llm = lambda: providers.llm_labels(entities, texts, *talk(config, model))
    return choose(config, "classifier", {"hf": lambda: providers.classify_terms(entities, texts, model), "llm": llm})()


def relations(config: dict, entities: DataFrame, texts: DataFrame, valid: DataFrame, model=None) -> DataFrame:
    """Relation extraction by `extractor`: hf, which is the default, or llm (with `concatenate_title_abstract`)."""
    llm = lambda: providers.llm_relations(entities, texts, valid, *talk(config, model), across=bool(config.get("concatenate_title_abstract")))
    return choose(config, "extractor", {"hf": lambda: providers.extract_relations(entities, texts, valid, model), "llm": llm}, "hf")()
