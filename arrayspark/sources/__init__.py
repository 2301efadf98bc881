"""Where arrays come from and go to: buffers, files, and external chunk stores."""
