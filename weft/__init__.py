"""Networks of points, pairs and trajectories as Spark tables: making, changing, analysing, embedding, labelling, ordering them.

``Graph`` has the operators as methods; makers of networks from points and parameters are functions of this package.
"""

from weft.graph import Graph
from weft.operators import analysis, embed, export, label, reorder, transform
from weft.operators.geometric import delaunay_graph, gabriel_graph, relative_neighborhood_graph, urquhart_graph
from weft.operators.manifold import directed_graph, flesh_out, inter_cluster_distance, manifold_spanning_graph, saffron
from weft.operators.matching import b_matching
from weft.operators.neighbors import nearest_neighbors, neighbor_graph
from weft.operators.regularized import smce_graph, sparse_regularized_graph
from weft.operators.spanning import disjoint_mst, mst, perturbed_mst
from weft.sources.datasets import FigureEight, MobiusStrip, SCurve, error_ratio, mountain_car_traces, mountain_car_trajectories, read_edges, read_points, swiss_roll, write_edges
from weft.sources.generators import chain_graph, chunk_up, concat_trajectories, downsample_trajectories, epsilon_net, fuzzy_c_means, lattice_graph, random_graph
from weft.streaming.incremental import incremental_edges, incremental_neighbor_graph

_METHODS = {
    analysis: ("ave_laplacian", "bandwidth", "betweenness", "connected_components", "diameter", "directed_laplacian", "eccentricity", "laplacian", "profile", "radius", "shortest_path"),
    transform: ("barycenter_edge_weights", "circle_tear", "connected_subgraphs", "cycle_cut", "isograph", "kernelize", "minimum_spanning_subtree", "neighborhood_subgraph", "shortest_path_subtree"),
    embed: ("isomap", "laplacian_eigenmaps", "laplacian_pca", "layout_circle", "layout_spring", "locality_preserving_projections", "locally_linear_embedding", "neighborhood_preserving_embedding"),
    label: ("bicolor_spectral", "classify_harmonic", "classify_lgc", "classify_local", "classify_nearest", "cluster_spectral", "color_greedy", "regression"),
    reorder: ("cuthill_mckee", "laplacian_reordering", "node_centroid_hill_climbing", "permute_graph"),
    export: ("plot", "segments", "to_html"),
}
for _module, _names in _METHODS.items():
    for _name in _names:
        setattr(Graph, _name, getattr(_module, _name))

__all__ = [
    "FigureEight", "Graph", "MobiusStrip", "SCurve", "b_matching", "chain_graph", "chunk_up", "concat_trajectories", "delaunay_graph", "directed_graph",
    "disjoint_mst", "downsample_trajectories", "epsilon_net", "error_ratio", "flesh_out", "fuzzy_c_means", "gabriel_graph", "incremental_edges",
    "incremental_neighbor_graph", "inter_cluster_distance", "lattice_graph", "manifold_spanning_graph", "mountain_car_traces", "mountain_car_trajectories", "mst",
    "nearest_neighbors", "neighbor_graph", "perturbed_mst", "random_graph", "read_edges", "read_points", "relative_neighborhood_graph", "saffron", "smce_graph",
    "sparse_regularized_graph", "swiss_roll", "urquhart_graph", "write_edges",
]
