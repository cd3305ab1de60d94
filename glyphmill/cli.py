"""Command line: python -m glyphmill.cli COMMAND ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans import commands


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="glyphmill", allow_abbrev=False)
    sub = top.add_subparsers(dest="command")

    def command(name, help_, **options):
        p = sub.add_parser(name, help=help_, allow_abbrev=False)
        for option, default in options.items():
            flag = "--" + option.replace("_", "-")
            if default is str:
                p.add_argument(flag, required=True)
            else:
                p.add_argument(flag, type=type(default) if default is not None else str, default=default)
        return p

    command("train", "train word vectors", input=str, output=str, vocab=None, vocab_size=50_000, dim=100, window=5, neg_samples=5, lr=0.025, epochs=5)
    command("bpe-train", "train a vocabulary", input=str, output=str, vocab_size=10_000)
    command("bpe-encode", "encode a text", vocab=str, text=str)
    command("similar", "most similar tokens", model=str, word=str, topk=10)
    command("analogy", "solve an analogy, as in: king - man + woman", model=str, query=str, topk=5)
    command("embed", "print a token's vector", model=str, word=str)
    p = command("info", "describe a vocabulary or model", model=None, vocab=None)
    p.add_argument("path", nargs="?")
    sub.add_parser("help", help="this text")
    return top


def _verbatim(argv: list[str]) -> list[str]:
    """An option takes the next argument as it is, also one that begins with a dash."""
    out, rest = [], list(argv)
    while rest:
        word = rest.pop(0)
        option = len(word) > 2 and word.startswith("--") and "=" not in word and word != "--help"
        out.append(f"{word}={rest.pop(0)}" if option and rest else word)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    top = parser()
    names = {"train", "bpe-train", "bpe-encode", "similar", "analogy", "embed", "info"}
    if not argv or argv[0] not in names:
        top.print_help()
        return 0
    a = top.parse_args(_verbatim(argv))
    try:
        if a.command == "info":
            path = a.model or a.vocab or a.path
            if path is None:
                raise ValueError("Missing file path")
            print("\n".join(commands.info(path)))
            return 0
        spark = spark or SparkSession.builder.getOrCreate()
        if a.command == "train":
            got = commands.train(spark, a.input, a.output, a.vocab, a.vocab_size, a.dim, a.window, a.neg_samples, a.lr, a.epochs)
            print(f"Vocabulary size: {got['tokens']}\nModel saved to {a.output}")
        elif a.command == "bpe-train":
            got = commands.bpe_train(spark, a.input, a.output, a.vocab_size)
            print(f"Vocabulary size: {len(got)}\nMerge rules: {len(got.rules)}")
        elif a.command == "bpe-encode":
            rows = commands.bpe_encode(spark, a.vocab, a.text).collect()
            ids = [i for r in rows for i in r.ids]
            print("\n".join(["Tokens:", *[f"  '{r.tok}' -> {list(r.ids)}" for r in rows], "", f"All token IDs: {ids}", f"Total: {len(ids)} tokens"]))
        elif a.command == "embed":
            v = [f" {x:>9.6f}" for x in commands.embed(spark, a.model, a.word)]
            print("\n".join([f"Embedding for '{a.word}' (dim={len(v)}):", "[", *["".join(v[k : k + 8]) for k in range(0, len(v), 8)], "]"]))
        else:
            found = commands.similar(spark, a.model, a.word, a.topk) if a.command == "similar" else commands.analogy(spark, a.model, a.query, a.topk)
            head = [f"Similar to '{a.word}':"] if a.command == "similar" else [f"Analogy: {a.query}", "Results:"]
            print("\n".join([*head, *[f"  {r.similarity:>6.4f}  {r.token}" for r in found.collect()]]))
    except (OSError, ValueError, LookupError) as wrong:
        print(f"Error: {wrong}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
