"""Sources and sinks: driver tables as frames, image files, FITS files, exports."""
