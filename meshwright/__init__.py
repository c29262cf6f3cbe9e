"""meshwright: geometric analytics and rule validation over triangle meshes, as Spark DataFrames."""
