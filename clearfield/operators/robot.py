"""Articulated models decomposed into spheres: kinematics, groups, and link clearances with joint gradients.

A model is metadata: a handful of links, joints and spheres. It is parsed on the driver and broadcast as arrays;
configurations and frames are DataFrames.
"""

from __future__ import annotations

import math
import xml.etree.ElementTree as ET
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import written
from .arrangement import evaluate

MOVABLE = ("revolute", "continuous", "prismatic")


@dataclass(frozen=True)
class Joint:
    name: str
    kind: str
    parent: str
    child: str
    xyz: tuple[float, float, float]
    rpy: tuple[float, float, float]
    axis: tuple[float, float, float]
    index: int  # place in the configuration, -1 for fixed joints


@dataclass(frozen=True)
class Sphere:
    link: str
    centre: tuple[float, float, float]
    radius: float


@dataclass(frozen=True)
class Model:
    """links: in topological order; joints: by child link; spheres: in order of the file."""

    links: tuple[str, ...]
    joints: dict[str, Joint]
    spheres: tuple[Sphere, ...]

    @property
    def dof(self) -> int:
        return sum(j.index >= 0 for j in self.joints.values())


def _numbers(text: str | None, default: str) -> tuple[float, float, float]:
    parts = tuple(float(x) for x in (text or default).split())
    if len(parts) != 3 or not all(map(math.isfinite, parts)):
        raise ValueError(f"three finite numbers are wanted: {text!r}")
    return parts


def parse_urdf(text: str) -> Model:
    """Model of a URDF text. Collisions must be spheres; movable joints must not mimic; links form one tree."""
    root = ET.fromstring(text)
    names = [link.get("name") for link in root.findall("link")]
    if len(set(names)) != len(names) or not names:
        raise ValueError("links need names of their own")
    spheres = []
    for link in root.findall("link"):
        for collision in link.findall("collision"):
            shape = collision.find("geometry/sphere")
            if shape is None:
                raise ValueError(f"link {link.get('name')} has a collision that is no sphere")
            radius = float(shape.get("radius"))
            if not radius > 0 or not math.isfinite(radius):
                raise ValueError("a sphere's radius must be positive")
            origin = collision.find("origin")
            spheres.append(Sphere(link.get("name"), _numbers(origin.get("xyz") if origin is not None else None, "0 0 0"), radius))
    joints: dict[str, Joint] = {}
    at = 0
    for j in root.findall("joint"):
        kind, parent, child = j.get("type"), j.find("parent").get("link"), j.find("child").get("link")
        if kind not in (*MOVABLE, "fixed"):
            raise ValueError(f"joint type {kind} is not supported")
        if kind != "fixed" and j.find("mimic") is not None:
            raise ValueError("movable joints must not mimic others")
        if parent not in names or child not in names or child in joints:
            raise ValueError("a joint needs a known parent and a child of its own")
        origin, axis = j.find("origin"), j.find("axis")
        a = np.array(_numbers(axis.get("xyz") if axis is not None else None, "1 0 0"))
        if kind != "fixed":
            if not np.linalg.norm(a) > 0:
                raise ValueError("a movable joint needs an axis")
            a = a / np.linalg.norm(a)
        joints[child] = Joint(
            j.get("name"), kind, parent, child, _numbers(origin.get("xyz") if origin is not None else None, "0 0 0"),
            _numbers(origin.get("rpy") if origin is not None else None, "0 0 0"), tuple(map(float, a)), at if kind != "fixed" else -1,
        )
        at += kind != "fixed"
    roots = [n for n in names if n not in joints]
    if len(roots) != 1:
        raise ValueError("the links need one root")
    order = [roots[0]]
    for link in order:
        order += [j.child for j in joints.values() if j.parent == link]
    if len(order) != len(names):
        raise ValueError("the links are not connected")
    return Model(tuple(order), joints, tuple(spheres))


def rotation(rpy: tuple[float, float, float]) -> np.ndarray:
    """Rz(yaw) Ry(pitch) Rx(roll)."""
    (r, p, y) = rpy
    x = np.array([[1, 0, 0], [0, math.cos(r), -math.sin(r)], [0, math.sin(r), math.cos(r)]])
    q = np.array([[math.cos(p), 0, math.sin(p)], [0, 1, 0], [-math.sin(p), 0, math.cos(p)]])
    z = np.array([[math.cos(y), -math.sin(y), 0], [math.sin(y), math.cos(y), 0], [0, 0, 1]])
    return z @ q @ x


def kinematics(model: Model, q: np.ndarray, base: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sphere centres (n, spheres, 3) and their Jacobians (n, spheres, 3, dof) at configurations q (n, dof)."""
    n, dof = q.shape
    turn = {model.links[0]: np.broadcast_to(np.eye(3) if base is None else base[:3, :3], (n, 3, 3))}
    move = {model.links[0]: np.broadcast_to(np.zeros(3) if base is None else base[:3, 3], (n, 3))}
    chain: dict[str, list[tuple[Joint, np.ndarray, np.ndarray]]] = {model.links[0]: []}
    for link in model.links[1:]:
        j = model.joints[link]
        r, t = turn[j.parent], move[j.parent]
        t = t + np.einsum("nij,j->ni", r, np.array(j.xyz))
        r = r @ rotation(j.rpy)
        chain[link] = chain[j.parent]
        if j.index >= 0:
            axis = np.einsum("nij,j->ni", r, np.array(j.axis))
            chain[link] = [*chain[link], (j, axis, t)]
            v = q[:, j.index]
            if j.kind == "prismatic":
                t = t + axis * v[:, None]
            else:
                k = np.array([[0, -j.axis[2], j.axis[1]], [j.axis[2], 0, -j.axis[0]], [-j.axis[1], j.axis[0], 0]])
                s, c = np.sin(v)[:, None, None], np.cos(v)[:, None, None]
                r = r @ (np.eye(3) + s * k + (1 - c) * (k @ k))
        turn[link], move[link] = r, t
    centres = np.empty((n, len(model.spheres), 3))
    jacobians = np.zeros((n, len(model.spheres), 3, dof))
    for i, sphere in enumerate(model.spheres):
        p = move[sphere.link] + np.einsum("nij,j->ni", turn[sphere.link], np.array(sphere.centre))
        centres[:, i] = p
        for j, axis, origin in chain[sphere.link]:
            jacobians[:, i, :, j.index] = axis if j.kind == "prismatic" else np.cross(axis, p - origin)
    return centres, jacobians


def groups(model: Model) -> list[tuple[str, list[int]]]:
    """Spheres that move together: (movable joint, sphere numbers), in order of the joints; the static base is in none."""
    found: dict[int, tuple[str, list[int]]] = {}
    for i, sphere in enumerate(model.spheres):
        link = sphere.link
        while link in model.joints and model.joints[link].index < 0:
            link = model.joints[link].parent
        if link in model.joints:
            j = model.joints[link]
            found.setdefault(j.index, (j.name, []))[1].append(i)
    return [found[k] for k in sorted(found)]


def link_alpha(model: Model, error: float) -> float:
    """Sharpness of the smooth minimum over a group for a wanted error: log of the largest group over it."""
    most = max((len(s) for _, s in groups(model)), default=1)
    return math.nextafter((math.log(most) if most > 1 else 1.0) / error, math.inf)


def sphere_poses(configurations: DataFrame, model: Model) -> DataFrame:
    """Rows (config_id, sphere_id, x, y, z, jac) of configurations (config_id, q array<double>); jac is row-major 3 x dof."""
    shared = configurations.sparkSession.sparkContext.broadcast(model)

    def run(frames):
        m = shared.value
        for frame in frames:
            for lo in range(0, len(frame), 1024):
                part = frame.iloc[lo : lo + 1024]
                centres, jac = kinematics(m, np.stack([np.asarray(v, dtype=float) for v in part["q"]]).reshape(len(part), m.dof))
                n, s = centres.shape[:2]
                yield pd.DataFrame(
                    {
                        "config_id": np.repeat(part["config_id"].to_numpy(), s), "sphere_id": np.tile(np.arange(s), n),
                        "x": centres[:, :, 0].ravel(), "y": centres[:, :, 1].ravel(), "z": centres[:, :, 2].ravel(),
                        "jac": list(jac.reshape(n * s, -1)),
                    }
                )

    return configurations.select("config_id", "q").mapInPandas(run, "config_id long, sphere_id int, x double, y double, z double, jac array<double>")


def sphere_clearances(field: DataFrame, model: Model, margin: float = 0.0) -> DataFrame:
    """field with clearance, radius, link_index and joint of each sphere; the last two are null on the static base.

    field: the smoothed function at sphere centres (``sphere_poses`` evaluated in frames), with sphere_id and
    q_upper. Clearance is -q_upper - radius - margin.
    """
    of = {i: (g, name) for g, (name, members) in enumerate(groups(model)) for i in members}
    rows = [(i, sphere.radius, *of.get(i, (None, None))) for i, sphere in enumerate(model.spheres)]
    table = F.broadcast(field.sparkSession.createDataFrame(rows, "sphere_id int, radius double, link_index int, joint string"))  # one row a sphere of the model
    return field.join(table, "sphere_id", "left").withColumn("clearance", -F.col("q_upper") - F.col("radius") - F.lit(margin))


def group_clearances(field: DataFrame, model: Model, margin: float = 0.0, error: float = 1e-3) -> DataFrame:
    """Smooth clearance of each group and its gradient in the joints, by frame and configuration.

    field: frame_id, config_id, sphere_id, jac, q_upper, gx, gy, gz. A group's clearance is the smooth minimum of
    its spheres', -log(sum exp(-alpha c)) / alpha, and its gradient the weighted mean of theirs. Spheres of the
    static base are in no group. One grouped list of a group's spheres, whose number the model bounds.
    """
    dof, alpha = model.dof, link_alpha(model, error)
    c = sphere_clearances(field, model, margin).where("link_index is not null")
    # The gradient of clearance is minus the function's, through the sphere's Jacobian.
    slope = [-(F.get("jac", F.lit(k)) * F.col("gx") + F.get("jac", F.lit(dof + k)) * F.col("gy") + F.get("jac", F.lit(2 * dof + k)) * F.col("gz")) for k in range(dof)]
    key = ["frame_id", "config_id", "link_index", "joint"]
    listed = c.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("clearance", "sphere_id", *[s.alias(f"g{k}") for k, s in enumerate(slope)]))).alias("s"))
    low = F.get("s", F.lit(0))
    weighed = listed.withColumn("low", low).withColumn("w", F.transform("s", lambda x: F.exp(-F.lit(alpha) * (x["clearance"] - F.col("low.clearance")))))
    weighed = weighed.withColumn("total", F.aggregate("w", F.lit(0.0), lambda a, x: a + x)).withColumn("spheres", F.size("s").cast("long"))

    def mean(k: int) -> Column:
        both = F.zip_with("w", "s", lambda w, x: w * x[f"g{k}"])
        return F.aggregate(both, F.lit(0.0), lambda a, x: a + x) / F.col("total")

    return weighed.select(
        *key,
        (F.col("low.clearance") - F.log("total") / alpha).alias("distance"),
        F.col("low.clearance").alias("hard_min"),
        F.col("low.sphere_id").alias("nearest_sphere"),
        "spheres",
        F.when(F.col("spheres") > 1, F.log(F.col("spheres").cast("double")) / alpha).otherwise(0.0).alias("bound"),
        F.array(*[mean(k) for k in range(dof)]).alias("gradient"),
    )


def described_spheres(field: DataFrame, model: Model, margin: float = 0.0) -> DataFrame:
    """Rows (frame_id, config_id, sphere): all that is known of a sphere, as a struct; joint and group are null on the static base.

    field: as ``field_at`` gives it. center_link is where the model has it, center where the configuration puts it.
    """
    number = {name: j.index for j in model.joints.values() for name in [j.name] if j.index >= 0}
    link = {j.name: j.child for j in model.joints.values()}
    of = {i: name for name, members in groups(model) for i in members}
    rows = [(i, s.link, list(s.centre), link.get(of.get(i)), number.get(of.get(i))) for i, s in enumerate(model.spheres)]
    table = F.broadcast(field.sparkSession.createDataFrame(rows, "sphere_id int, link string, center_link array<double>, group_link string, joint_index int"))  # one row a sphere of the model
    found = sphere_clearances(field, model, margin).join(table, "sphere_id")
    return found.select(
        "frame_id",
        "config_id",
        F.struct(
            F.col("sphere_id").alias("id"), "link", "center_link", "joint", "group_link", "joint_index", F.array(*"xyz").alias("center"), "radius",
            F.col("q_upper").alias("environment_value"), "clearance", F.array("gx", "gy", "gz").alias("gradient"),
        ).alias("sphere"),
    )


def described_groups(found: DataFrame, model: Model) -> DataFrame:
    """group clearances with the group's link, the links its spheres are of, and the joint's place in the configuration."""
    by_name = {j.name: j for j in model.joints.values()}
    rows = [(name, by_name[name].child, by_name[name].index, sorted({model.spheres[i].link for i in members})) for name, members in groups(model)]
    table = F.broadcast(found.sparkSession.createDataFrame(rows, "joint string, link string, joint_index int, source_links array<string>"))  # one row a joint
    return found.join(table, "joint")


def field_at(poses: DataFrame, frames: DataFrame, programs: DataFrame, error: float = 1e-3) -> DataFrame:
    """The smoothed function of every frame (frames: frame_id) at every sphere of every pose: that is the question asked.

    So the result has as many rows as poses times frames; poses stay dealt out as they are. They are written first, a
    row for many of the result, so that a task of the result runs one Python worker and not another for its poses.
    """
    return evaluate(written(poses).crossJoin(frames.select("frame_id")), programs, error=error)


#: A small arm of our own: a turning column, a lifting carriage and a swinging tool.
DEMO_URDF = """
<robot name="post">
  <link name="base"><collision><origin xyz="0 0 0.1"/><geometry><sphere radius="0.05"/></geometry></collision></link>
  <link name="column">
    <collision><origin xyz="0 0.1 0"/><geometry><sphere radius="0.04"/></geometry></collision>
    <collision><origin xyz="0 0.3 0"/><geometry><sphere radius="0.03"/></geometry></collision></link>
  <link name="plate"><collision><origin xyz="0.05 0 0"/><geometry><sphere radius="0.02"/></geometry></collision></link>
  <link name="carriage"><collision><origin xyz="0 0.2 0.1"/><geometry><sphere radius="0.04"/></geometry></collision></link>
  <link name="tool"><collision><origin xyz="0.2 0 0"/><geometry><sphere radius="0.03"/></geometry></collision>
    <collision><origin xyz="0.3 0 0.05"/><geometry><sphere radius="0.02"/></geometry></collision></link>
  <joint name="turn" type="revolute"><parent link="base"/><child link="column"/><origin xyz="0 0 0.2"/><axis xyz="0 0 1"/></joint>
  <joint name="bolt" type="fixed"><parent link="column"/><child link="plate"/><origin xyz="0 0.2 0" rpy="0 0 0.5"/></joint>
  <joint name="lift" type="prismatic"><parent link="column"/><child link="carriage"/><origin xyz="0.1 0 0" rpy="0 0.1 0"/><axis xyz="0 0 1"/></joint>
  <joint name="swing" type="continuous"><parent link="carriage"/><child link="tool"/><origin xyz="0 0.3 0"/><axis xyz="0 1 0"/></joint>
</robot>
"""
