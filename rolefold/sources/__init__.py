"""Where facts come from and go to: star tables, containers, interchange formats, dumps."""
