"""Vocabularies of the queries, chosen for the publication records they run on."""

from corpusloom.operators.evidence import Taxonomy, Vocabulary

VOCAB = Vocabulary(
    core_prefixes=("G06N3/06", "G06N3/3", "G06N3/5"),
    topic_prefixes=("G06N",),
    topic_excluded=("G06N10", "G06N20/9"),
    device_prefixes=("G11C", "H10N", "H01L", "H03K", "G06F7/"),
    topic_text=r"\b(?:spiking core|neuron circuit|synapse cell|training coprocessor|inference tile|membrane potential)\b",
    mechanism_text=r"\b(?:dot[\s\-]product engine|tensor pipeline|partial sums|kernel window)\b",
    device_text=r"\b(?:crossbar array|stacked die|sense amplifier|charge pump|bit[\s\-]line driver|scratchpad bank)\b",
    weak_text=r"\b(?:core|circuit|memory|pipeline|engine|chip)\b",
    veto_text=r"\b(?:phase shifter|photonic mixer|parity bit)\b",
)

TAXONOMY = Taxonomy({
    "Dataflow": (("DMA",), ("tensor pipeline", "dot product engine")),
    "Memory-centric": ((), ("crossbar array", "scratchpad bank", "bit line driver")),
    "Neuromorphic": ((), ("spiking core", "synapse cell", "neuron circuit")),
    "Photonic": ((), ("photonic mixer", "phase shifter")),
    "Sparse": ((), ("sparsity decoder", "sparse activation")),
})

#: Free-text hints, first match wins.
HINTS = [
    ("systolic|tensor|dataflow|accelerat", "DATAFLOW"),
    ("neuron|memrist|synap|spik|dendrit", "NEUROMORPHIC"),
    ("bank|sram|dram|memory|crossbar", "MEMORY"),
    ("optic|photon|ring|diffract", "PHOTONIC"),
    ("logic|tile|bitstream", "LOGIC"),
]
#: Category names as typed -> canonical.
CANONICAL = {"DATAFLOW": "Dataflow", "NEUROMORPHIC": "Neuromorphic", "MEMORY": "Memory-centric", "PHOTONIC": "Photonic", "LOGIC": "Logic", "NONE": "NONE"}

FIRST, LAST, COMPLETE_TO = 2010, 2024, 2022
#: Score bands, half-open.
BANDS = [(0.9, 1.01), (0.85, 0.9), (0.8, 0.85), (0.75, 0.8), (0.7, 0.75), (0.6, 0.7)]
LOW_BANDS = [(0.6, 1.01), (0.5, 0.6), (0.4, 0.5), (0.3, 0.4), (0.2, 0.3), (0.0, 0.2)]
KEPT_TYPES = ("patent application", "granted patent", "amended application")
