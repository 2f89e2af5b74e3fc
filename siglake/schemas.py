"""Table layouts that operators share."""

SAMPLES = "sid string, idx int, v double"
SIGNALS = "sid string, samples array<double>"
FRAMES = "sid string, frame int, n int, v double"
PIXELS = "img string, r int, c int, v double"
EDGES = "g string, i int, j int, w double"
NODES = "g string, i int, ch int, v double"
TENSORS = "tid string, shape array<int>, data array<double>"
TREE = "tid string, path string, level int, shape array<int>, data array<double>"
