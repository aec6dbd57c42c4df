"""An extension: files of creators as a stream."""
