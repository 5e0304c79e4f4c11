"""Command line: ``extract`` (audio to embeddings) and ``cluster`` (embeddings to speaker segments)."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from segspark.operators.vectors import Plda, Transform
from segspark.plans import diarize as D
from segspark.ship import ensure
from segspark.sources import kaldi, models, text, wav


def flag(value: str) -> bool:
    """A real boolean: only yes or no words are taken."""
    if value.lower() in ("1", "true", "yes"):
        return True
    if value.lower() in ("0", "false", "no"):
        return False
    raise argparse.ArgumentTypeError(f"yes or no expected, not {value!r}")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="segspark", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("extract")
    for name in ("in-file-list", "in-lab-dir", "in-wav-dir", "out-ark-fn", "out-seg-fn"):
        e.add_argument(f"--{name}", required=True)
    e.add_argument("--model", default="pooling", choices=sorted(models.REGISTRY))
    e.add_argument("--weights", default="")
    e.add_argument("--backend", default=None, choices=["pytorch", "onnx"], help="short for --model torch (torch_state with --network) or onnx")
    e.add_argument("--network", default="", help="package.module:Class whose state --weights holds")
    e.add_argument("--ndim", type=int, default=64, help="dimensions of a feature vector, for --network")
    e.add_argument("--embed-dim", type=int, default=256, help="dimensions of an embedding, for --network")
    e.add_argument("--seg-len", type=int, default=144)
    e.add_argument("--seg-jump", type=int, default=24)
    c = sub.add_parser("cluster")
    for name in ("out-rttm-dir", "xvec-ark-file", "segments-file", "xvec-transform", "plda-file"):
        c.add_argument(f"--{name}", required=True)
    c.add_argument("--init", default="AHC+VB", help="AHC, AHC+VB or random_<speakers>")
    for name, kind, value in (("threshold", float, -0.015), ("lda-dim", int, 128), ("Fa", float, 0.4), ("Fb", float, 17.0), ("loopP", float, 0.9), ("init-smoothing", float, 5.0), ("target-energy", float, 1.0)):
        c.add_argument(f"--{name}", type=kind, default=value)
    # the published command takes --target-energy and does not use it; it steers dense PLDA scores only
    c.add_argument("--output-2nd", type=flag, default=False)
    return p


def extract(spark: SparkSession, a: argparse.Namespace) -> None:
    wanted = text.read_list(spark, a.in_file_list)
    audio = wav.read_chunks(spark, f"{a.in_wav_dir}/*.wav").join(wanted, "rec", "left_semi")
    vad = text.read_vad(spark, f"{a.in_lab_dir}/*.lab").join(wanted, "rec", "left_semi")
    model = {"pytorch": "torch_state" if a.network else "torch", "onnx": "onnx"}.get(a.backend, a.model)
    weights = models.state_path(a.weights, a.network, a.ndim, a.embed_dim) if model == "torch_state" else a.weights
    rows = D.extract(audio, vad, a.seg_len, a.seg_jump, model, weights).persist()
    text.write_lines(rows.repartitionByRange("rec", "idx").sortWithinPartitions("rec", "idx"), text.timing_line(F.col("key"), F.col("rec"), F.col("start"), F.col("end")), a.out_seg_fn)
    kaldi.write_archive(rows, a.out_ark_fn)


def cluster(spark: SparkSession, a: argparse.Namespace) -> None:
    t = models.read_transform(a.xvec_transform)
    mu, tr, psi = kaldi.read_plda(a.plda_file)
    settings = D.Settings(a.threshold, a.lda_dim, a.Fa, a.Fb, a.loopP, a.init_smoothing, init=a.init)
    labels = D.diarize(kaldi.read_archive(spark, a.xvec_ark_file), Transform(t["mean1"], t["lda"], t["mean2"]), Plda(mu.tolist(), tr.tolist(), psi.tolist()), settings).persist()
    D.write_results(labels, text.read_timings(spark, a.segments_file), a.out_rttm_dir, a.output_2nd)


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("segspark").getOrCreate()
    ensure(spark)
    {"extract": extract, "cluster": cluster}[a.command](spark, a)


if __name__ == "__main__":
    main()
