"""Models on disk: the fitted pipeline, and beside it as JSON what it is and what features it takes."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from .protocol import Fitted

SCHEMA_VERSION, ARTIFACT = 1, "sequoria_model"
#: Fields of a contract and their types.
FIELDS = {"artifact_type": str, "schema_version": int, "model_name": str, "model_family": str, "params": dict, "features": dict, "training": dict}


def contract(name: str, made: Fitted, features: dict, training: dict) -> dict:
    """What a bundle says of its model. features: kind, dimension, and names or widths of blocks; training: free."""
    return {"artifact_type": ARTIFACT, "schema_version": SCHEMA_VERSION, "model_name": name, "model_family": made.name, "params": dict(made.params), "features": dict(features), "training": dict(training)}


def differences(held: object, expected: dict) -> list[str]:
    """What of a contract is not as expected, field by field; expected: fields, and of features those that matter."""
    if not isinstance(held, dict):
        return [f"a contract is a table of fields, this is {type(held).__name__}"]
    out = [f"field {k} is missing" for k in FIELDS if k not in held]
    out += [f"field {k} is {type(held[k]).__name__}, not {t.__name__}" for k, t in FIELDS.items() if k in held and not isinstance(held[k], t)]
    if out:
        return out
    want = {"artifact_type": ARTIFACT, "schema_version": SCHEMA_VERSION} | {k: v for k, v in expected.items() if k != "features"}
    out += [f"field {k} is {held[k]!r}, expected {v!r}" for k, v in want.items() if held[k] != v]
    return out + [f"feature {k} is {held['features'].get(k)!r}, expected {v!r}" for k, v in expected.get("features", {}).items() if held["features"].get(k) != v]


def save(made: Fitted, path: str, name: str, features: dict, training: dict | None = None) -> dict:
    """Writes model and contract to the folder path, which all machines reach; gives the contract."""
    said = contract(name, made, features, training or {})
    made.model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps(said | {"column": made.features}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/contract")
    return said


def load(spark: SparkSession, path: str, name: str, features: dict | None = None) -> tuple[Fitted, dict] | None:
    """The model and its contract; None where there is no bundle. One that is not as expected is an error that names
    every field that differs."""
    try:
        held = json.loads(spark.read.text(f"{path}/contract", wholetext=True).first()[0])
    except AnalysisException:  # no such folder
        return None
    except (ValueError, TypeError) as e:
        raise ValueError(f"the contract of {name} cannot be read: {e}") from e
    if wrong := differences(held, {"model_name": name, "features": features or {}}):
        raise ValueError("; ".join(wrong))
    model = PipelineModel.load(f"{path}/model")
    return Fitted(held["model_family"], held["params"], model, held.get("column", "features")), held


@dataclass
class Registry:
    """Models by branch; a branch without a bundle is not in it, one whose bundle is not sound has a warning."""

    models: dict[str, Fitted] = field(default_factory=dict)
    contracts: dict[str, dict] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


def load_registry(spark: SparkSession, root: str, expected: dict[str, dict]) -> Registry:
    """The bundles root/<branch> of the branches of `expected`, each with the features that it must have."""
    out = Registry()
    for name, features in expected.items():
        try:
            got = load(spark, f"{root}/{name}", name, features)
        except Exception as e:  # whatever is wrong with one bundle, the others count
            out.warnings.append(f"{name}: bundle not loaded, {type(e).__name__}: {str(e)[:200]}")
            continue
        if got:
            out.models[name], out.contracts[name] = got
    return out
