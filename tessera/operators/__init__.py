"""Search, nearest neighbours, joins, clustering and tree tables over SpatialFrames."""
