"""Numbers that the data model fixes."""

MAX_ZOOM = 20
TILE_BITS = 12
#: Pixels along an axis at MAX_ZOOM.
WORLD = 1 << (MAX_ZOOM + TILE_BITS)
EXTENT = 4096
#: Pixels at MAX_ZOOM that a tile is drawn beyond its own edge.
OVERDRAW = 4096
#: Zoom of the storage cells.
CELL_ZOOM = 10
DEFAULT_MAX_Z = 21
COASTLINE = "coastline"
POINT, LINE, POLYGON = 1, 2, 3
#: A polygon smaller than this many square pixels is a sub-pixel one: (4096 / 256)^2.
SUBPIXEL_AREA = 256
BOOL_FALSE, BOOL_TRUE, STRING, NUMERIC, INTEGER = range(5)
