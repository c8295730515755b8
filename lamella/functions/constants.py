"""Fixed values of the data and of voxel rendering."""

#: Consolidated class by raw class name, as the cell annotation uses them.
CLASS_MAP = {
    "adipocytes": "Adipocyte",
    "B cells": "B cells",
    "plasma cells": "B cells",
    "CD3+ T cells": "T Cells",
    "CD4+ T cells": "T cells",
    "CD4+ T cells CD45RO+": "T cells",
    "CD4+ T cells GATA3+": "T cells",
    "CD8+ T cells": "T cells",
    "granulocytes": "Granulocytes",
    "CD11b+CD68+ macrophages": "Macrophages",
    "CD163+ macrophages": "Macrophages",
    "CD68+ macrophages": "Macrophages",
    "CD68+ macrophages GzmB+": "Macrophages",
    "CD68+CD163+ macrophages": "Macrophages",
    "NK cells": "NK cells",
    "nerves": "Nerves",
    "CD11b+ monocytes": "Monocytes",
    "smooth muscle": "Smooth muscle cells",
    "Tregs": "Tregs",
    "tumor cells": "Neoplastic cells",
    "lymphatics": "Vasculature",
    "vasculature": "Vasculature",
    "CD11c+ DCs": "Dendritic cells",
    "stroma": "Others",
}

UNKNOWN = "Inconnu"

#: Corners of a unit cube around a voxel's centre (dx, dy, dz), and its twelve triangles by corner.
CORNERS = [(-0.5, -0.5, -0.5), (0.5, -0.5, -0.5), (0.5, 0.5, -0.5), (-0.5, 0.5, -0.5), (-0.5, -0.5, 0.5), (0.5, -0.5, 0.5), (0.5, 0.5, 0.5), (-0.5, 0.5, 0.5)]
FACES = [(7, 3, 0), (0, 4, 7), (0, 1, 2), (0, 2, 3), (4, 5, 6), (4, 6, 7), (6, 5, 1), (6, 2, 1), (4, 0, 5), (0, 1, 5), (3, 6, 7), (2, 3, 6)]

DEPTH = 64
CENTRE_Z = 32
VIEW_THRESHOLD, TRAIN_THRESHOLD, MESH_THRESHOLD = 0.01, 0.05, 0.05
SIGMA, THICKNESS = 2.5, 16
MIN_DEPTH, MIN_SPATIAL = 3, 8
MICRONS = {"CODEX": 0.377, "RESTORE": 0.15}
SHOW_ALL, HIDE_ABOVE, HIDE_BELOW = "Tout afficher", "Masquer au-dessus", "Masquer au-dessous"
GAUSSIAN, LINEAR, NONE = "Gaussien", "Linéaire", "Aucune"
